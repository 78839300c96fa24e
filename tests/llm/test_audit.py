"""Filter audit against a walk of every document through every order."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from flotilla.llm import audit


def brute_failures(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = "A" if len(words) < 100 else ""
        fails += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
        fails += "D" if re.search("[#$%&*|]", t) else ""
        fails += "E" if i is not None and i > first[t] else ""
        yield i, lang or "", fails


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = list(brute_failures(rows))
    out, removed_by = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in judged}:
            left = [(i, f) for i, p, f in judged if p == part]
            total = list(left)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = sum(letter in f for _, f in total)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(f == letter for _, f in total),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.select(*columns).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_awkward_documents(spark, awkward):
    # Copies across parts, null ids among them, a tie of the limits of B and C, markup.
    words = " ".join(f"w{i}" for i in range(80)) + " w0" * 20
    more = [(50, words, "en"), (51, words, None), (None, words, "en"), (52, "A" + "b" * 9, ""), (53, "AA" + "b" * 9, "fr"), (54, "x # y", "fr"),
            (55, None, "fr"), (55, None, "fr"), (56, words + " w0", "de")]
    docs = awkward.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    docs = docs.withColumn("mask", F.lit("x")).withColumn("part", F.lit(1)).withColumn("id", F.lit(2))
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (None, 1, 1), (51, 1, 0), (999, 1, 1), (55, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("y"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert result(audit.filter_audit(docs, frame)) == brute_audit(rows, labels)
    assert result(audit.filter_audit(docs, frame.limit(0))) == brute_audit(rows, [])


def test_empty_table(spark, empty):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, labels).count() == 0


@pytest.mark.parametrize("values", [[0, *range(1, 32)], [0] * 32, [bin(s).count("1") ** 2 for s in range(32)]])
def test_potential_is_that_of_the_recursion(spark, values):
    want = [0.0] * 32
    for s in range(1, 32):
        members = [i for i in range(5) if s >> i & 1]
        want[s] = (values[s] + sum(want[s ^ 1 << i] for i in members)) / len(members)
    got = spark.createDataFrame([(values,)], "v array<long>").select(audit.potentials(F.col("v")).alias("p")).first().p
    assert got == pytest.approx([120 * w for w in want])
