"""Personal data, line dedup, decontamination and mixing against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from flotilla.llm import bitmap, decontaminate, line_dedup, mixing, pii

from .conftest import LINE

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute_spans(text):
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if brute_valid(kind, m[0])
    ]
    return [s for _, _, s in sorted(found)]


ODD = [
    "a@b.c%d@e.f-g h@@i.j é@x.yz 😀 mail me@you.example.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.1 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 +1 (212) 555-0100 +12 +123456789",
    "1 " * 3000 + "x" * 5000 + "@" + "y." * 100,
    "9" * 20000,
    "",
]


def test_base_spans_match_plain_regexes(spark, awkward, documents):
    rows = spark.createDataFrame([(700 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(rows).unionByName(documents.select("doc_id", "text"))
    got = pii.digest(pii.protect(docs)).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert len(got) == docs.count()
    for r in got:
        options = [brute_spans(t) for t in texts[r.doc_id]]
        hashes = {hashlib.sha256(",".join(o).encode()).hexdigest(): o for o in options}
        assert r.base_sha256 in hashes
        spans = hashes[r.base_sha256]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans


def test_disclosing_terms_are_found_and_rewritten(spark):
    names = "common words flow around every text here with nothing special inside".split()
    rows = [(i, f"{names[i % 10]} {names[(i + 3) % 10]} ordinary sentence number {i}") for i in range(60)]
    rows += [(100 + i, f"{names[i % 10]} writes Zorblax {names[i]} at boss{0}@secret.example.com {names[i + 1]} number {i}") for i in range(5)]
    rows += [(200, "nobody knows Zorblax in person"), (201, "Zorblaxian is another word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = pii.protect(df)
    got = {r.doc_id: r for r in out.withColumn("clean", pii.sanitised(out)).collect()}
    terms = lambda i: [s.value for s in got[i].spans if s.rank == 4]
    assert terms(100) and "Zorblax" in terms(100) and terms(200) == ["Zorblax"] and terms(201) == []
    assert all(not got[i].spans for i in range(60))
    assert "secret" not in got[101].clean and "Zorblax" not in got[101].clean and "[EMAIL]" in got[101].clean
    assert got[201].clean == "Zorblaxian is another word"
    assert pii.protect(df.limit(0)).count() == 0


def test_short_name_near_an_address_seen_once(spark):
    """One mention is enough for a rare term; exact copies change no count; common words stay."""
    rows = [(i, f"we met on ordinary day {i}") for i in range(60)]
    rows += [(100, "we met Kim at kim.secret@mail.example.com on day 7")]
    rows += [(200 + i, "an ordinary day for Kim alone") for i in range(6)]
    out = pii.protect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [s.value for s in r.spans if s.rank == 4] for r in out.collect()}
    assert "Kim" in got[100] and all(got[200 + i] == ["Kim"] for i in range(6))
    assert "we" not in got[100] and not any(got[i] for i in range(60))


def brute_terms(texts):
    """What each term near an entity leaves to find out, over distinct texts."""
    texts = sorted(set(texts))
    near, holding = {}, {}
    for number, text in enumerate(texts):
        for word in set(re.findall(r"[^\W\d_]+", text.lower())):
            holding[word] = holding.get(word, 0) + 1
        for kind, pattern in BASE.items():
            for m in re.finditer(pattern, text):
                if not brute_valid(kind, m[0]):
                    continue
                a, b = max(0, m.start() - pii.AROUND), min(len(text), m.end() + pii.AROUND)
                for w in re.finditer(r"[^\W\d_]+", text):
                    if (a <= w.start() and w.end() <= m.start()) or (m.end() <= w.start() and w.end() <= b):
                        near.setdefault((kind, m[0], w[0].lower()), set()).add(number)
    left = {}
    for (_, _, word), where in near.items():
        bits = -math.log2(len(where) / (holding[word] + pii.PRIOR))
        left[word] = min(bits, left.get(word, bits))
    return {w: b for w, b in left.items() if b <= pii.GENERALISE}


def people(spark, more=0):
    rng = random.Random(3)
    common = "here are many plain words that say nothing of anyone at all".split()
    rows = [(i, " ".join(rng.choices(common, k=12))) for i in range(40 + more)]
    for i in range(10):
        first = f"name{'abcdefghij'[i]}"
        rows.append((1000 + i, f"{rng.choice(common)} {first} of city{'uvw'[i % 3]} wrote from u{i}@mail.example.org on {rng.choice(common)} days"))
        rows += [(3000 + 10 * i + k, f"{first} once more at u{i}@mail.example.org on {k}") for k in range(3) if i % 5 == 0]
        rows += [(2000 + 10 * i + k, f"{first} {rng.choice(common)} again in {k}") for k in range(i % 4)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_against_brute_force(spark):
    docs = people(spark)
    want = brute_terms([r.text for r in docs.collect()])
    assert len(want) > 5 and any(b <= pii.REMOVE for b in want.values())
    out = pii.protect(docs)
    for r in out.collect():
        spans = [s for s in r.spans if s.rank < 4]
        terms = {
            (m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", r.text)
            if m[0].lower() in want and not any(s.start < m.end() and m.start() < s.end for s in spans)
        }
        assert {(s.start, s.end) for s in r.spans if s.rank == 4} == terms
        assert set(r.removed) <= {w for w, b in want.items() if b <= pii.REMOVE}


def test_unrelated_documents_change_no_decision(spark):
    def decided(docs):
        return {r.doc_id: (r.spans, sorted(r.removed)) for r in pii.protect(docs).collect() if r.doc_id >= 1000}

    few = people(spark)
    extra = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("quite unrelated sentence number "), F.col("id")).alias("text"))
    assert decided(few) == decided(few.unionByName(extra))


def test_cross_site_lines_go_but_for_the_first(awkward, empty):
    got = line_dedup.without_boilerplate(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[20].clean_text == by[20].text and by[20].removed_lines == 0
    for i in range(21, 26):
        assert by[i].clean_text == f"own text number {i - 20} of site {i - 20}" and by[i].removed_lines == 1
    assert by[3].clean_text is None and by[4].clean_text == "" and by[None].removed_lines == 0
    assert all(by[i].score == "x" for i in by) and LINE in by[20].clean_text
    assert line_dedup.without_boilerplate(empty).count() == 0


def test_white_space_at_the_ends_does_not_tell_lines_apart(spark):
    ends = ["", " ", "\t", "\r", " \r", "\x0b", "\t \r", "\x0c"]
    rows = [(i, f"a line that stands on eight sites{end}\nown words of site {i}", f"s{i}") for i, end in enumerate(ends)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == {i: int(i > 0) for i in range(8)}
    assert all(r.clean_text == f"own words of site {r.doc_id}" for r in got if r.doc_id)


def test_log_like_text_of_many_removed_lines(spark):
    lines = [f"boilerplate line number {i} of the log" for i in range(30_000)]
    rows = [(s, "\n".join(lines if s else lines + ["the end of it"]), f"s{s}") for s in range(5)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.removed_lines for r in got} == {s: 30_000 * (s > 0) for s in range(5)}
    assert all(r.clean_text == (r.text if r.doc_id == 0 else "") for r in got)


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(s * 100 + i, f"line of exactly {s} sites for the test", f"site{i}") for s in range(1, 12) for i in range(s)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.without_boilerplate(df, sites=6).groupBy(F.floor(F.col("doc_id") / 100).alias("s")).agg(F.sum("removed_lines").alias("n"))
    assert {r.s: r.n for r in got.collect()} == {s: (s - 1 if s >= 6 else 0) for s in range(1, 12)}


def test_passages_with_substitutions_are_found(spark, awkward):
    words = [f"token{i}" for i in range(40)]
    changed = [w if i % 7 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame(
        [(1, "before " + " ".join(words) + " after"), (2, "Before, " + " ".join(changed).upper() + "!"),
         (3, " ".join(words[:12])), (4, " ".join(w if i % 2 else "other" for i, w in enumerate(words))),
         (5, None), (6, ""), (None, " ".join(words)), (1, "another text of document one")],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(0, " ".join(words)), (0, " ".join(words)), (1, "too short"), (2, None), (None, "")], "item_id long, text string")
    got = decontaminate.flag_documents(docs, bench).collect()
    flagged = sorted(str(r.doc_id) for r in got if r.contaminated)
    assert flagged == ["1", "2", "None"] and len(got) == 8
    assert decontaminate.flag_documents(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.flag_documents(awkward, bench).where("contaminated").count() == 0
    assert decontaminate.flag_documents(awkward.limit(0), bench).count() == 0


def needed(n):
    """Agreeing tokens that an item of n tokens (or its best window) needs."""
    return n if n < decontaminate.SHORT else -(-decontaminate.NEED * min(n, decontaminate.WINDOW) // decontaminate.WINDOW)


def test_masks_see_every_substitution_the_rule_admits():
    for n in range(decontaminate.SHORT, decontaminate.WINDOW + 1):
        for gone in combinations(range(n), n - needed(n)):
            assert any(
                all(at + o not in gone for o in mask) for mask in decontaminate.MASKS for at in range(n - max(mask))
            ), (n, gone)


def brute_overlap(doc, item):
    d, t = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (doc, item))
    if not t:
        return False
    width = min(len(t), decontaminate.WINDOW)
    for g in range(-len(t), len(d) + 1):
        same = [0 <= i + g < len(d) and d[i + g] == t[i] for i in range(len(t))]
        if any(sum(same[j : j + width]) >= needed(len(t)) for j in range(len(t) - width + 1)):
            return True
    return False


def test_substitutions_short_items_and_chance_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in (1, 2, 5, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 25)]
    docs = [(1000, "w1 w2"), (1001, ""), (1002, None)]
    for n, text in items:
        for k in range(12):  # up to one substitution more than the rule admits
            words = text.split()
            for at in rng.sample(range(n), min(n, rng.randint(0, n - needed(n) + 1))):
                words[at] = "changed"
            pad = [" ".join(rng.choices(["x", "y", "z"], k=rng.randint(0, 3))) for _ in range(2)]
            docs.append((n * 100 + k, f"{pad[0]} {' '.join(words)} {pad[1]}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.flag_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    want = {i: sum(brute_overlap(text, item) for _, item in items) for i, text in docs}
    assert {r.doc_id: r.n_items for r in got} == want and len(got) == len(docs)
    assert all(r.contaminated == (r.n_items > 0) for r in got)


def test_short_item_word_for_word(spark, awkward):
    docs = spark.createDataFrame([(1, "so it says: Six tokens, word for word! yes"), (2, "six tokens word for other word"), (3, "six tokens")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "six tokens word for word yes"), (1, "..."), (2, "six tokens")], "item_id long, text string")
    got = {r.doc_id: r.n_items for r in decontaminate.flag_documents(docs, bench).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_bit_filter_grows_with_its_keys(spark):
    assert bitmap.slots_for(0) * 64 == bitmap.LEAST_BITS and bitmap.slots_for(10**9) * 64 == bitmap.MOST_BITS
    keys = spark.range(200_000).select(F.xxhash64("id").alias("key"))
    bits = bitmap.bits_of(keys, 200_000)
    assert keys.where(~bitmap.may_hold(bits, F.col("key"))).count() == 0
    others = spark.range(1_000_000, 1_100_000).select(F.xxhash64("id").alias("key"))
    assert others.where(bitmap.may_hold(bits, F.col("key"))).count() < 2_000


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3.0 * sizes[s] for s in above)
        free -= above
    return target


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    texts = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    assert sorted((str(a), str(b), c) for a, b, c in texts) == sorted((str(r.doc_id), str(r.source), r.size) for r in rows)
    sizes = {}
    for _, s, n in texts:
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1
    return rows, taken, targets


def test_mix_meets_targets(documents, awkward, empty):
    rows, taken, targets = check_mix(documents)
    assert max(abs(taken[s] / targets[s] - 1) for s in targets) < 0.05
    again = mixing.mix(documents.repartition(3)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in again)
    check_mix(awkward)
    assert mixing.mix(empty).count() == 0


def test_mix_of_one_repeated_document(spark):
    check_mix(spark.createDataFrame([(i, "same five words in each", "a") for i in range(300)] + [(999, "b " * 30, "b")], "doc_id long, text string, source string"))
