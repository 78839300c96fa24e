"""Token counts against the tokenizers library; exact top-k against brute force."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flotilla.llm import tokens, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_match_the_library(awkward, documents):
    docs = awkward.select("doc_id", "text").unionByName(documents.select("doc_id", "text").limit(150))
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaaaaa", "日本語 😀😀 é́", "\x1c\x85 a​", "  x \n\n y's 'S"]
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    known = Tokenizer.from_file(PATH).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = sorted((str(i), len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(rows, known, strict=True))
    got = tokens.token_counts(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


@pytest.fixture(scope="module")
def texts_and_counts(documents):
    texts = [r.text or "" for r in documents.select("text").orderBy("doc_id").limit(300).collect()]
    return texts, [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_do_not_hang_on_the_grouping(texts_and_counts):
    texts, want = texts_and_counts
    merges = tokens.Merges(PATH)
    warm = tokens.Counter(merges)
    assert [warm.count([t])[0] for t in texts] == want  # one document a group, one warm counter
    assert [tokens.Counter(merges).count([t])[0] for t in texts] == want  # a fresh one for each
    for size in (2, 7, 50):
        groups = [texts[i : i + size] for i in range(0, len(texts), size)]
        assert [n for g in groups for n in tokens.Counter(merges).count(g)] == want


def test_every_pretoken_alone(texts_and_counts):
    merges = tokens.Merges(PATH)
    find = tokens.Counter(merges).find
    pieces = sorted({p for t in texts_and_counts[0][:60] for p in find(t)})
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(pieces, add_special_tokens=False)]
    alone = [int(tokens.count_symbols(merges, [p.encode()])[0]) for p in pieces]
    assert alone == want == tokens.count_symbols(merges, [p.encode() for p in pieces]).tolist()
    assert len(tokens.count_symbols(merges, [])) == 0


@pytest.mark.parametrize("seed", ["0", "1", "2", "3"])
def test_counts_do_not_hang_on_set_order(texts_and_counts, seed):
    texts, want = texts_and_counts
    code = (
        "import json, sys; from flotilla.llm import tokens; path, texts = json.load(sys.stdin);"
        "c = tokens.Counter(tokens.Merges(path)); print(json.dumps([c.count([t])[0] for t in texts]))"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-c", code], input=json.dumps([PATH, texts[:80]]), capture_output=True, text=True, check=True,
        cwd=root, env={**os.environ, "PYTHONHASHSEED": seed},
    )
    assert json.loads(done.stdout) == want[:80]


def test_no_documents(empty):
    assert tokens.token_counts(empty, PATH).count() == 0


def brute_top(rows, every, k):
    """Sorted answer rows: every usable row is a candidate, a query leaves out its own row only."""
    vectors = [
        (i, [int((256 * x) // 1) for x in v]) for i, v in rows
        if i is not None and v is not None and not any(x is None or x != x or abs(x) == float("inf") for x in v)
    ]
    out = []
    for own, (q, v) in enumerate(vectors):
        if q % every == 0:
            near = sorted(
                (-sum(a * b for a, b in zip(v, c, strict=True)), i) for n, (i, c) in enumerate(vectors) if n != own and len(c) == len(v)
            )
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def top(df, *args):
    return sorted(tuple(r) for r in topk.exact_top_k(df, *args).collect())


CLASHING = ("score", "rank", "row", "v", "dim", "chunk", "range", "block", "group", "floor", "high", "low", "n")


def test_top_k_with_ties_nulls_and_few_vectors(spark):
    rows = [(0, [0.5, -0.25]), (50, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.25, 0.0]), (100, [0.1, 0.2, 0.3]), (150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    assert top(df, 50, 3) == brute_top(rows, 50, 3)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.1, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (50, [1.0, 1.0]), (50, [0.0, -1.0]), (2, [0.0, 0.0]), (150, []), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top(df, 50, 4)
    assert got == brute_top(rows, 50, 4)
    assert (0, 1, 1, 256 * 5 * 256) in got and (0, 2, 1, 256 * 5 * 256) in got


def test_top_k_of_large_components(spark):
    rows = [(i, [float((i * 7919) % 101 - 50) * 1e5, float(i) * 1e5]) for i in range(0, 120)]
    assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 5) == brute_top(rows, 50, 5)


@pytest.mark.parametrize("first", [1, 3])
def test_top_k_over_several_ranges_and_blocks(spark, monkeypatch, first):
    for name, value in {"RANGE_BLOCKS": 3, "GROUP_BLOCKS": 8, "CHUNK": 4, "BLOCK": 16, "FIRST": first}.items():
        monkeypatch.setattr(topk, name, value)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert top(df) == brute_top(rows, 50, 5)


def test_blocks_below_the_floor_are_not_shuffled(spark, monkeypatch):
    """Long vectors lie together, so a query's floor from the best block rules out nearly all others."""
    for name, value in {"RANGE_BLOCKS": 4, "GROUP_BLOCKS": 16, "CHUNK": 8, "BLOCK": 16}.items():
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [(100.0 if i < 40 else 0.01) * (1 + i % 7), 1.0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shuffled = []
    plain = topk.score_cells
    monkeypatch.setattr(topk, "score_cells", lambda q, b, keys, k: (shuffled.append(b.count()), plain(q, b, keys, k))[1])
    assert top(df, 50, 5) == brute_top(rows, 50, 5)
    blocks = 2000 / 16
    assert shuffled[1] < 0.1 * blocks * 40 / 8  # (block, chunk) pairs; without a floor all of them
