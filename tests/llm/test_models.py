"""URL language models against a brute-force version; toxicity and language ID by held-out quality."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotilla.llm import langid, toxicity, url_filter

from .conftest import SF


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def brute_scores(urls, held):
    """Mean log ratio of every url by Witten-Bell interpolation over plain dictionaries."""
    k = url_filter.ORDER
    counts = {"allow": Counter(), "block": Counter()}
    part = {}
    for u in urls:
        text = (u or "")[u.index("://") + 3 :] if u and "://" in u else (u or "")
        part[u] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        rule = brute_rule(u)[2]
        if rule and u not in held:
            padded = url_filter.PAD * k + part[u]
            for i in range(k, len(padded)):
                for n in range(k + 1):
                    counts[rule.verdict][padded[i - n : i + 1]] += 1
    history = {v: Counter() for v in counts}
    types = {v: Counter() for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            history[v][(len(g), g[:-1])] += n
            types[v][(len(g), g[:-1])] += 1

    def p(v, gram):
        low = p(v, gram[1:]) if len(gram) > 1 else 1 / url_filter.ALPHABET
        h = (len(gram), gram[:-1])
        total = history[v][h] + types[v][h]
        return (counts[v][gram] + types[v][h] * low) / total if total else low

    out = {}
    for u, text in part.items():
        padded = url_filter.PAD * k + text
        grams = [padded[i - k : i + 1] for i in range(k, len(padded))]
        out[u] = sum(math.log(p("block", g) / p("allow", g)) for g in grams) / len(grams) if grams else 0.0
    return out


def test_url_rules_and_scores_match_brute_force(spark):
    odd = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/a?b#c", "http://example.com", "http://x.net/fr/../1",
           "http://a.com/", "http://net/es/1", "ftp://xnet/es/1", "http://a.example.com/en/1", "http://a.example.com/en?x"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(odd)] + [(None, "http://a.com/x")], "page_id long, url string")
    pages = pages.unionByName(extra).withColumn("score", F.lit(1)).withColumn("w", F.lit(2))
    got = url_filter.filter_urls(pages).collect()
    by_id = {r.page_id: r.url for r in pages.collect()}
    held = {r.url for r in pages.select("url").distinct().where(F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)) == 0).collect()}
    want = brute_scores(set(by_id.values()), held)
    assert len(got) == pages.count()
    for r in got:
        host, path, rule = brute_rule(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.score == pytest.approx(want[by_id[r.page_id]], abs=1e-9)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    free = [r for r in got if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    assert all((r.verdict == "block") == (r.block_probability > 0.5) for r in free)


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(pages).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_very_long_urls_and_ties(spark):
    long = "http://elsewhere.org/" + "segment/" * 1_000
    rows = [(1, long), (2, long), (3, "http://"), (4, "http://?" + "q" * 5_000), (5, ""), (6, None)]
    rows += [(10 + i, f"http://www{i}.shop.com/item/{i}") for i in range(30)] + [(50 + i, f"http://es{i}.net/es/pagina/{i}") for i in range(30)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and got[1].score == got[2].score and got[1].verdict == got[2].verdict
    assert got[1].host == "elsewhere.org" and got[1].path == long[len("http://elsewhere.org") :] and got[4].path == "" == got[4].host
    assert all(got[i].score == 0.0 for i in (3, 5, 6) if i != 3)
    for r in got.values():
        if r.rule is None:
            assert r.verdict == ("block" if r.block_probability > 0.5 else "allow")


def test_language_of_held_out_documents(documents, awkward, empty):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(awkward).collect()
    assert len(odd) == awkward.count()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {3, 4, 5, 8}
    assert langid.identify(empty).count() == 0


def test_words_of_code_switched_text(documents):
    sample = langid.training_sample(documents, 4, 2)
    model = langid.train([t for t, _ in sample], [g for _, g in sample])
    text = "the thing that is the and of the " + "der und die nicht von das " + "para que los de la ción"
    labels = [g for _, g in langid.word_languages(model, text)]
    assert labels[:4] == ["en"] * 4 and labels[-3:] == ["es"] * 3 and "de" in labels


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = rng.normal(size=(7, 3))
    first = np.array([0, 4, 5, 7])
    got = langid.forward_backward(scores, first, model)
    for a, b in zip(first[:-1], first[1:], strict=True):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            s = model.start[path[0]] + sum(scores[a + t, c] for t, c in enumerate(path))
            s += sum(model.transitions[x, y] for x, y in zip(path, path[1:]))
            want[np.arange(b - a), path] += math.exp(s)
        assert got[a:b] == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-5)


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_toxicity_of_held_out_documents(spark, documents, awkward, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert area(np.array([r.score for r in got]), np.array([r.toxic for r in got])) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    few = spark.createDataFrame([(1, None), (None, 1), (7, 0), (20, 0), (20, 0)], "doc_id long, toxic int")
    odd = toxicity.toxicity(awkward, few).collect()
    assert len(odd) == awkward.count() and {r.score for r in odd} == {0.0}
    assert toxicity.toxicity(empty, few).count() == 0


def test_recurrent_gradients_match_differences():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights().items()}
    inputs = rng.normal(size=(5, toxicity.INPUT))
    table = rng.integers(0, 6, size=(3, toxicity.WINDOW))
    table[:, 0] = 0
    d = np.array([1.0, -2.0, 0.5])

    def value():
        return float(toxicity.forward(w, inputs, table)[0] @ d)

    _, kept = toxicity.forward(w, inputs, table, keep=True)
    grad, d_inputs = toxicity.backward(w, inputs, table, kept, d)
    for name, at in (("h_f", (2, 5)), ("x_b", (1, 20)), ("attention", (3,)), ("out", (9,)), ("bias_f", (18,))):
        old = w[name][at]
        w[name][at] = old + 1e-3
        up = value()
        w[name][at] = old - 1e-3
        down = value()
        w[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)
    old = inputs[2, 3]
    inputs[2, 3] = old + 1e-3
    up = value()
    inputs[2, 3] = old - 1e-3
    down = value()
    assert d_inputs[2, 3] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    words = toxicity.find_words(np.frombuffer(b"a b c " * 50, np.uint8), np.array([0, 300]), toxicity.LETTERS_DIGITS)
    table, doc = toxicity.window_table(words, np.arange(150), 150)
    assert set(range(150)) <= set(table.ravel()) and len(table) == 7 and set(doc) == {0}
    # Any phrase of half a window lies whole in some window.
    half = toxicity.WINDOW // 2
    rows = [set(r.tolist()) for r in table]
    assert all(any(set(range(a, a + half)) <= r for r in rows) for a in range(150 - half + 1))


def test_labelled_texts_that_are_all_long(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 400)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2_000)
    rng = np.random.default_rng(2)
    plain, rude = [f"plain{i}" for i in range(40)], [f"rude{i}" for i in range(10)]
    rows = []
    for i in range(120):
        words = list(rng.choice(plain, 400))
        if i % 2:
            for at in range(0, 400, 8):
                words[at] = str(rng.choice(rude))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(500, 1), (501, 1), (999, 1)], "doc_id long, toxic int")
    sample, share = toxicity.training_sample(docs, labels, 5, 0)
    assert {len(t) for t, _ in sample} == {2_000} and {y for _, y in sample} == {0, 1} and 0.4 < share < 0.6
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(120)) and got[500].score == got[501].score < 0.5


def made_up_languages(count, seed=3):
    """Vocabularies of different letters and endings, one for each language."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return {f"l{i:03d}": ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(12)] for i in range(count)}


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 2)
    words = made_up_languages(210)
    rng = np.random.default_rng(4)
    rows = [(i * 10 + k, " ".join(rng.choice(words[name], 60)), name) for i, name in enumerate(words) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} == set(words)  # the last ones in code-point order, too
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_languages_of_long_or_few_texts(spark):
    words = made_up_languages(4)
    rng = np.random.default_rng(6)
    long = [(i, " ".join(rng.choice(words["l000"], 6000)), "l000") for i in range(0, 9)]
    few = [(20, " ".join(words["l001"][:5]), "l001"), (21, " ".join(words["l001"][5:]), "l001")]
    rest = [(30 + i, " ".join(rng.choice(words[n], 50)), n) for i in range(24) for n in ("l002", "l003") if i % 2 == (n == "l003")]
    assert all(len(t) > langid.TRAIN_CHARS for _, t, _ in long)
    docs = spark.createDataFrame(long + few + rest, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, 4, 2)
    assert {g for _, g in sample} == set(words) and max(len(t) for t, _ in sample) == langid.TRAIN_CHARS
    test = spark.createDataFrame([(i, " ".join(words[n]), n) for i, n in enumerate(words)], "doc_id long, text string, lang string")
    model = langid.train([t for t, _ in sample], [g for _, g in sample])
    assert [r.lang_pred for r in langid.predict(test, model).orderBy("doc_id").collect()] == list(words)


def test_weight_table_stays_within_its_bound():
    for count in (1, 4, 256, 257, 5000, 60_000):
        rows = langid.buckets_for(count)
        assert rows & (rows - 1) == 0 and (rows * count <= langid.WEIGHTS or rows == 256)
    assert langid.buckets_for(4) == langid.BUCKETS


def test_pair_expectations_match_enumeration():
    rng = np.random.default_rng(8)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, gold = rng.normal(size=(2, 4, 3)), rng.integers(0, 3, (2, 4))
    by_score, moves, start = langid.pair_expectations(scores, gold, model)
    want_score, want_moves = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for r in range(2):
        total, node, pair = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
        for path in np.ndindex(3, 3, 3, 3):
            p = math.exp(model.start[path[0]] + sum(scores[r, t, c] for t, c in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:])))
            total += p
            node[np.arange(4), path] += p
            for x, y in zip(path, path[1:]):
                pair[x, y] += p
        want_score[r] = np.eye(3)[gold[r]] - node / total
        want_moves -= pair / total
        for x, y in zip(gold[r], gold[r][1:]):
            want_moves[x, y] += 1
    assert by_score == pytest.approx(want_score) and moves == pytest.approx(want_moves)
    assert start == pytest.approx(want_score[:, 0].sum(axis=0))
