"""Licence scan: base places against a plain search, expressions against plain recursion."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from flotilla.llm import licences, queries

from .conftest import SF

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    places = [(i, label) for p, label in PHRASES.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


ODD = [
    "CC-BY cc by CC by", "cc\nby", "cc byx", "xcc by", "ÀLL rights reserved. All-rights_reserved!", "all rights all rights reserved",
    "GNU General  Public\tLicense", "cc by nc cc by", "日本 cc by 日本", "cc", "a", "cc by" * 3, "cc0by", "caſe cc by",
]


def test_base_places(spark, awkward, documents):
    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = licences.licence_scan(docs.withColumn("labels", F.lit("x")).withColumn("score", F.lit("y"))).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), *map(str, brute_base(r.text))) for r in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_no_documents(empty):
    assert licences.licence_scan(empty).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.queries()["op12_licence_scan"](spark, SF).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:  # the notices of the given table, each on its own line
        t = texts[r.doc_id]
        want = set(filter(None, r.base_labels.split(",")))
        for notice, labels in {
            "Released under the MIT License.": {"mit"},
            "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
            "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
            "General Public License, version 3.": {"gpl-3.0"},
        }.items():
            want |= labels if notice in t else set()
        assert set(filter(None, r.labels.split(","))) == want


def found(text):
    s = licences.scan(text, licences.automaton())
    return sorted(s.labels), pytest.approx(s.score)


def test_notices():
    permissive, copyleft, limited = licences.PERMISSIVE, licences.COPYLEFT, licences.LIMITED
    assert found("Released under the MIT License.") == (["mit"], permissive)
    # The longest notice names the licence; the base phrase inside stays a label.
    assert found("Licensed under CC BY-NC 4.0.") == (["cc-by", "cc-by-nc"], limited)
    assert found("GNU Lesser General Public License") == (["gpl", "lgpl"], licences.SHARE_FILES)
    # A choice takes the freest, a sum the strictest; statements apart add up.
    assert found("under the MIT License or the GNU General Public License")[1] == permissive
    assert found("under the MIT License and the GNU General Public License")[1] == copyleft
    assert found("The MIT License covers code. GNU General Public License, too.")[1] == copyleft
    assert found("MIT License or All rights reserved")[1] == permissive
    assert found("nothing here") == ([], 0.0) and found(None) == ([], 0.0) and found("") == ([], 0.0)


def test_identifier_expressions():
    tag = "// SPDX-License-Identifier: "
    assert found(tag + "MIT")[0] == ["mit"]
    assert found(tag + "(MIT OR GPL-2.0-only) AND Apache-2.0 \nint main") == (["apache-2.0", "gpl-2.0-only", "mit"], licences.PERMISSIVE)
    assert found(tag + "MIT OR GPL-2.0-only AND Proprietary")[1] == licences.PERMISSIVE  # and binds closer
    assert found(tag + "GPL-2.0-or-later WITH Classpath-exception-2.0") == (["gpl-2.0-or-later"], licences.COPYLEFT / 2)
    assert found(tag + "MIT/Apache-2.0")[0] == ["apache-2.0", "mit"]
    # Broken ones: what is named still counts.
    assert found(tag + "((MIT AND")[0] == ["mit"]
    assert found(tag + "MIT) OR OR ISC")[0] == ["isc", "mit"]
    assert found(tag)[0] == [] and found(tag + "\nMIT")[0] == []
    assert found(f"{tag}MIT more prose follows\n{tag}ISC")[0] == ["isc", "mit"]


def recursive(tree):
    if isinstance(tree, str):
        return licences.weight_of(tree)
    op, a, b = tree
    if op == "with":
        return recursive(a) * licences.EXCEPTION_EASES
    return (max if op == "and" else min)(recursive(a), recursive(b))


def written(tree, above=0):
    if isinstance(tree, str):
        return tree
    op, a, b = tree
    own = licences.PRECEDENCE[op]
    inner = f"{written(a, own)} {op} {written(b, own + 1)}"
    return f"({inner})" if own < above else inner


def test_random_expressions_against_their_trees():
    rng = random.Random(5)
    names = ["mit", "gpl-3.0", "agpl-3.0-only", "cc0-1.0", "cc-by-nc-4.0", "mpl-2.0", "odd-one"]

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            leaf = rng.choice(names)
            return ("with", leaf, "some-exception") if rng.random() < 0.2 else leaf
        return (rng.choice(["and", "or"]), grow(depth - 1), grow(depth - 1))

    for _ in range(300):
        tree = grow(4)
        text = written(tree)
        assert licences.evaluate(licences.expression_tokens(text))[0] == pytest.approx(recursive(tree)), text
