"""Near-duplicate components against brute force; the corpus pipeline's stages on their own inputs."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from flotilla.llm import minhash, mixing
from flotilla.llm.common import saved

from .conftest import SF, awkward_rows

WORD = re.compile(r"[^ \t-\r]+")
FOLD = {k: k + 32 for k in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j > k).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both) and None not in (i, sets[j][0]):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((str(i), len(s), str(None if i is None else find(i)), i is None or find(i) == i) for i, s in sets)


def check(df, n, percent):
    got = minhash.near_duplicates(df, n, percent).collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()], n, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want


def test_documents_match_brute_force(documents):
    check(documents, 3, 85)


def test_awkward_rows(awkward, empty):
    check(awkward, 3, 85)
    check(awkward, 5, 80)
    assert minhash.near_duplicates(empty).count() == 0


def test_one_id_with_several_texts(spark):
    """A doc_id links whatever its texts are near."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(2, a), (5, a), (5, b), (9, b), (7, c), (7, c), (11, "nothing like the others at all"), (5, "only five says this and that")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {2: 2, 5: 2, 9: 2, 7: 7, 11: 11}
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SF).select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == {2, 7, 11}


def test_one_large_group_of_edited_copies(spark):
    """Hundreds of copies of one text with a few to many edits, some of which form groups of their own."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows, family = [], base
    for i in range(500):
        if i % 60 == 0:
            family = [w if rng.random() > 0.25 else f"f{i}x{k}" for k, w in enumerate(base)] if i else base
        source = family if i % 2 else base
        edits = rng.choice([0, 1, 2, 3, 5, 9])
        text = list(source)
        for _ in range(edits):
            text[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_long_chain_is_one_component(spark):
    """Ids descend after the first, so the smallest one has the whole chain to cross; others have random ids."""
    rng = random.Random(5)
    mixed = rng.sample(range(10_000, 20_000), 300)
    chains = [[1, *range(400, 1, -1)], mixed, [-7, -9]]
    edges = [(a, b) for ids in chains for a, b in zip(ids, ids[1:], strict=False)]
    nodes = [(i,) for ids in chains for i in ids] + [(9_000,)]
    got = minhash.components(spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: min(ids) for ids in chains for i in ids} | {9_000: 9_000}
    assert len(got) == len(want) and {r.node: r.label for r in got} == want


def test_further_edges_join_components(spark):
    rng = random.Random(7)
    nodes = spark.range(300).withColumnRenamed("id", "node")
    draw = lambda n: spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(n)], "a long, b long")
    first, more, none = draw(90), draw(70), draw(1).limit(0)
    labels = saved(minhash.components(nodes, first), "test-labels")
    want = sorted(minhash.components(nodes, first.unionByName(more)).collect())
    assert sorted(minhash.joined_further(labels, more).collect()) == want
    assert sorted(minhash.joined_further(labels, none).collect()) == sorted(labels.collect())


def test_small_rounds_write_few_files(spark, monkeypatch):
    """A round of few rows takes a task a core, however many partitions a shuffle has."""
    files = {}

    def counted(df, name):
        out = saved(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(minhash, "saved", counted)
    cores = spark.sparkContext.defaultParallelism
    settings = {"spark.sql.shuffle.partitions": str(4 * cores), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(2_000).select(F.col("id").alias("a"), (F.col("id") + F.col("id") % 3).alias("b"))
        minhash.components(spark.range(2_000).withColumnRenamed("id", "node"), edges).count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert all(0 < files[name] <= cores for name in ("parents", "labels", "low"))


def test_plan_of_a_mixing_round_holds_its_state_once(spark):
    histogram = spark.createDataFrame([("a", 4, 9), ("a", 7, 3), (None, 0, 2), ("b", 5, 1)], "source string, size long, n long")
    state = spark.createDataFrame(
        [("a", 50.0, 4.75, 0.0, -64.0, 64.0, False), (None, 0.0, 0.0, 0.0, -64.0, 64.0, False), ("b", 15.0, 5.0, 0.5, -64.0, 64.0, True)],
        "source string, target double, mean double, lam double, low double, high double, done boolean",
    )
    out = state
    for _ in range(3):
        out = mixing.newton_step(histogram, out)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3
    one = {r.source: r for r in mixing.newton_step(histogram, state).collect()}
    # 57 words of a: 50 - 57 over the slope (36 * 4 + 21 * 7) / 4.75.
    assert abs(one["a"].lam + 7 * 4.75 / 291) < 1e-9 and not one["a"].done and one["a"].high == 0.0
    assert one[None].done and one[None].lam == 0.0 and one["b"].done and one["b"].lam == 0.5


def test_signature_is_a_shifted_permutation_minimum():
    """Coordinate k is the minimum of pi at the permuted places shifted by k, computed here one by one."""
    import numpy as np

    sets = np.array([5, 77, 123456789, 2**63 + 11], np.uint64)
    got = minhash.signatures(sets, np.array([0, 3, 3, 4]), 16)
    rng = np.random.default_rng(minhash.SEED)
    sigma, pi = rng.permutation(minhash.UNIVERSE), rng.permutation(minhash.UNIVERSE)
    for row, part in ((0, sets[:3]), (2, sets[3:])):
        places = [sigma[int(s) % minhash.UNIVERSE] for s in part]
        assert got[row].tolist() == [min(pi[(p + k) % minhash.UNIVERSE] for p in places) for k in range(16)]
    assert (got[1] == minhash.UNIVERSE).all()


def test_pipeline_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF), f"test-{name}")
        steps[name] = (docs, out)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out
    before, after = steps["language"]
    assert before.count() - after.count() <= 5  # the table's documents all have a language
    before, after = steps["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {int(i) for i, _, _, kept in brute(rows, 5, 80) if kept}
    assert {r.doc_id for r in after.collect()} == want
    before, after = steps["decontamination"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in bench for k in range(len(w) - 12)}
    whole = {r.doc_id for r in before.collect() if any(tuple(w[k : k + 13]) in grams for w in [r.text.lower().split()] for k in range(len(w) - 12))}
    assert whole <= gone and len(gone) <= len(whole) + 3
    before, after = steps["mixing"]
    copies = after.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 3 and {r.doc_id for r in copies} <= {r.doc_id for r in before.collect()}
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total = before.agg(F.sum(size)).first()[0]
    assert abs(after.agg(F.sum(size)).first()[0] / total - 1) < 0.05


def test_mixing_of_repeated_rows_takes_what_the_mix_takes(spark):
    one = "fourteen words " * 7
    rows = [(1, one, "a")] * 22 + [(2, one, "a")] * 5 + [(None, one, "a")] * 9 + [(10 + i, "word " * (5 + i), "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = corpus_pipeline.mixing.mix(docs)
    want = {r.doc_id: r.c for r in mixed.groupBy("doc_id").agg(F.sum("copies").alias("c")).collect() if r.c}
    got = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want
    target = mixed.where("source = 'a'").first().target
    assert abs(14 * got.where("source = 'a'").count() - target) <= 14
    numbers = [r.copy_no for r in got.where("doc_id = 1").collect()]
    assert max(numbers) - min(numbers) <= 1 or numbers.count(max(numbers)) == want[1] % 22


def test_run_leaves_only_the_results(spark, tmp_path):
    from flotilla.session import checkpoint_root

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(40 if name == "documents" else 1000).write.parquet(f"{tmp_path}/{name}.parquet")
    root = checkpoint_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() > 0 and set(rows.columns) >= {"doc_id", "text", "copy_no", "target"}
    left = set(os.listdir(root)) - before
    assert sorted(n.rsplit("-", 1)[0] for n in left) == sorted(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES)


def test_run_over_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        assert out.columns[: len(awkward.columns)] == awkward.columns, name
        rows = out.count()
        assert 0 < rows <= 3 * len(awkward_rows()), name
        assert stage(spark, empty, SF).count() == 0, name
