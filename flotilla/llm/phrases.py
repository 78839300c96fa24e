"""Phrase collocations by mergeable Misra-Gries summaries, counted exactly in a second pass.

First pass. Every n-gram (one to three words of one piece, per language) is
known by a 64-bit key; its leading bits name one of ``parts`` hash partitions.
A task counts the keys of a group of texts and sends each partition one packed
array of keys and counts. There the arrays merge into one Misra-Gries summary:
counts add up, and if more than the capacity are left, the (capacity + 1)-th
largest count is taken off all and what reaches zero goes. Taking off d removes
at least d * (capacity + 1) from the partition's mass, so in sum no more than
mass / (capacity + 1) < threshold goes off any count as long as the capacity
exceeds mass / threshold: every n-gram that occurs ``threshold`` times
survives. Counts are cut at the threshold before they are sent, which changes
neither that promise nor which n-grams it holds for, and keeps very frequent
words from filling the mass of their partition.

Second pass. Survivors go into a bit filter, a segment per hash partition,
``FILTER_BYTES`` in all at the most. The texts are read again, the n-grams
that pass are counted exactly by their words. A test that passes wrongly only
costs a row of that count, whose sums decide; nothing that the filter lets
through is trusted.

Scores, cuts and the rule on longer phrases are joins on the exact counts.
The memory of a task is bounded by a group of texts (``GROUP_BYTES``, or one
text, if longer) and by a partition's summary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .words import ASCII_FOLD, BYTES, find_words, mix, text_groups

LEAST = 10
LONGEST = 3
TOP = 2000
# A longer phrase with at least this share of a phrase's occurrences takes its place.
COVER_PERCENT = 50
SCALE = 1_000_000

GROUP_BYTES = 2 << 20
# Bytes of text for each hash partition: about a million keys to merge at a time.
PART_BYTES = 4 << 20
FILTER_BYTES = 32 << 20
# The summaries hold more than mass / threshold by this factor, so that fewer rare n-grams are left.
HEADROOM = 2
KEY_BYTES = 5
UNKNOWN_LANG = "und"

BLANK = (BYTES == 32) | (BYTES == 9)
BREAK = np.isin(BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
IN_WORD = ~(BLANK | BREAK)


class Grams:
    """The n-grams of the texts of one group: first word, number of words and 64-bit key of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = ASCII_FOLD[data]
        w = self.words = find_words(self.data, offsets, IN_WORD, fold=False)
        count = len(w.start)
        # Words are neighbours when no break and no end of text lies between them.
        breaks = np.r_[np.zeros(1, np.int32), np.cumsum(BREAK[self.data], dtype=np.int32)]
        near = (w.doc[1:] == w.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])
        lang = mix(langs.astype(np.uint64)[w.doc] + np.uint64(1))
        first, keys = [], []
        at = np.arange(count)
        for n in range(1, LONGEST + 1):
            if n > 1:  # what goes on for one word more
                at = at[at + n - 1 < count]
                at = at[near[at + n - 2]]
            key = lang[at] + np.uint64(n)
            for i in range(n):
                key = mix(key * np.uint64(3) + w.hash[at + i])
            first.append(at)
            keys.append(key)
        self.first, self.key = np.concatenate(first), np.concatenate(keys)
        self.size = np.repeat(np.arange(1, LONGEST + 1), [len(f) for f in first])

    def check(self, which: np.ndarray) -> np.ndarray:
        """A second key of some n-grams, independent of the first: 128 bits tell n-grams of a group apart."""
        first, size = self.first[which], self.size[which]
        out = size.astype(np.uint64)
        for i in range(LONGEST):
            more = np.flatnonzero(size > i)
            out[more] = mix(out[more] * np.uint64(5) + mix(self.words.hash[first[more] + i] ^ np.uint64(0x5851F42D4C957F2D)))
        return out

    def phrases(self, which: np.ndarray) -> pa.Array:
        """The words of some n-grams, joined by single blanks."""
        w, first, size = self.words, self.first[which], self.size[which]
        # Words of all these n-grams end to end, a blank behind each but an n-gram's last.
        word = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last = np.zeros(len(word), bool)
        last[np.cumsum(size) - 1] = True
        length = w.end[word] - w.start[word] + ~last
        begin = np.cumsum(length) - length
        at = np.repeat(w.start[word] - begin, length) + np.arange(length.sum())
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[(begin + length - 1)[~last]] = 32
        ends = np.r_[0, np.cumsum(np.add.reduceat(length, np.cumsum(size) - size))] if len(which) else np.zeros(1, np.int64)
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def language_numbers(langs: pa.Array) -> np.ndarray:
    """A 64-bit number for each row's language, the same in every task."""
    coded = langs.fill_null(UNKNOWN_LANG).dictionary_encode()
    names = [np.frombuffer(n.encode().ljust(-(-len(n.encode()) // 8) * 8 or 8, b"\0"), np.uint64) for n in coded.dictionary.to_pylist()]
    numbers = np.zeros(len(names), np.uint64)
    for i, blocks in enumerate(names):
        for b in blocks:
            numbers[i] = mix(numbers[i : i + 1] * np.uint64(31) + b)[0]
    return numbers[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)


def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, pa.Array]]:
    """N-grams of each group of the batches' texts (lang, text), and the rows' languages."""
    for batch in batches:
        langs = batch.column(0).fill_null(UNKNOWN_LANG)
        numbers = language_numbers(langs)
        for a, b, data, offsets in text_groups(batch.column(1), GROUP_BYTES):
            yield Grams(data, offsets, numbers[a:b]), langs.slice(a, b - a)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition of keys: their leading bits; ``parts`` is a power of two."""
    return (key >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(key), np.int64)


def pack(key: np.ndarray) -> bytes:
    """The last KEY_BYTES bytes of keys; with the partition's bits that is all the first pass needs."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(raw: bytes | pa.Buffer) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :KEY_BYTES] = flat
    return out.view("<u8").ravel().astype(np.uint64)


def low(key: np.ndarray) -> np.ndarray:
    return key & np.uint64((1 << 8 * KEY_BYTES) - 1)


def merge(key: np.ndarray, count: np.ndarray, more_key: np.ndarray, more: np.ndarray, capacity: int):
    """Two Misra-Gries summaries as one of at most ``capacity`` counters: (keys, counts, what was taken off)."""
    keys = np.concatenate([key, more_key])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], np.concatenate([count, more])[by]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[head], np.add.reduceat(counts, head, dtype=np.int64) if len(head) else counts.astype(np.int64)
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return keys[left], counts[left] - off, off


def summary(blobs: list[bytes | pa.Buffer], counts: list[bytes | pa.Buffer], least: int) -> tuple[np.ndarray, int]:
    """Keys of one hash partition that may occur ``least`` times, and its mass."""
    numbers = [np.frombuffer(c, np.uint8) for c in counts]
    mass = int(sum(c.sum(dtype=np.int64) for c in numbers))
    capacity = (mass // least + 1) * HEADROOM
    key, count, error = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    start = size = 0
    for i, c in enumerate(numbers):
        size += len(c)
        if size < capacity and i + 1 < len(numbers):
            continue  # arrays of about the summary's own size are merged at once
        more = np.concatenate([unpack(b) for b in blobs[start : i + 1]])
        key, count, off = merge(key, count, more, np.concatenate(numbers[start : i + 1]), capacity)
        error += off
        start, size = i + 1, 0
    return key[count + error >= least], mass


def filter_slots(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers of each (low) key in a segment of ``slots`` bits."""
    a, b = mix(keys + np.uint64(11)), mix(keys + np.uint64(13))
    return a & np.uint64(slots - 1), b & np.uint64(slots - 1)


def segment(keys: np.ndarray, slots: int) -> bytes:
    bits = np.zeros(slots, bool)
    for slot in filter_slots(keys, slots):
        bits[slot.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Survivors:
    """The bit filter of the second pass: segments end to end, and where each partition's begins."""

    def __init__(self, parts: int, segments: dict[int, tuple[int, bytes]]):
        self.parts = parts
        self.slots = np.ones(parts, np.uint64)
        self.begin = np.zeros(parts, np.int64)
        data, at = [b"\0"], 1  # partitions without a survivor look at the zero byte
        for part, (slots, raw) in sorted(segments.items()):
            self.slots[part], self.begin[part] = slots, at
            data.append(raw)
            at += len(raw)
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def passes(self, key: np.ndarray) -> np.ndarray:
        part = part_of(key, self.parts)
        ok = np.ones(len(key), bool)
        for value in (11, 13):
            slot = (mix(low(key) + np.uint64(value)) & (self.slots[part] - np.uint64(1))).astype(np.int64)
            ok &= (self.data[self.begin[part] + (slot >> 3)] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return ok


def prepared(documents: DataFrame) -> DataFrame:
    """(lang, text), null lang as 'und'."""
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))


def survivors(texts: DataFrame, least: int) -> Survivors:
    """First pass: the filter over all n-grams that may occur ``least`` times."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(4, (max(1, size // PART_BYTES) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, _ in grams_of(batches):
            keys, counts = np.unique(grams.key, return_counts=True)
            if not len(keys):
                continue
            counts = np.minimum(counts, least).astype(np.uint8)
            part = part_of(keys, parts)  # keys are sorted, so are the parts
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            pieces = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cut[:-1]], pa.int64()),
                    pa.array([pack(keys[p]) for p in pieces], pa.binary()),
                    pa.array([counts[p].tobytes() for p in pieces], pa.binary()),
                ],
                ["part", "keys", "counts"],
            )

    def reduce(group: pa.Table) -> pa.Table:
        keys, mass = summary([k.as_buffer() for k in group["keys"]], [c.as_buffer() for c in group["counts"]], least)
        most = 1 << max(3, (FILTER_BYTES * 8 // parts).bit_length() - 1)
        slots = min(most, 1 << max(3, (16 * max(1, len(keys)) - 1).bit_length()))
        out = [[group["part"][0].as_py()], [mass], [len(keys)], [slots], [segment(keys, slots)]]
        return pa.table([pa.array(v, t) for v, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["part", "mass", "kept", "slots", "bits"])

    packed = texts.mapInArrow(count, "part long, keys binary, counts binary")
    found = packed.groupBy("part").applyInArrow(reduce, "part long, mass long, kept long, slots long, bits binary")
    # At most FILTER_BYTES (and a byte for each of more partitions than that) come to the driver.
    rows = found.where(F.col("kept") > 0).select("part", "slots", "bits").collect()
    return Survivors(parts, {r.part: (r.slots, bytes(r.bits)) for r in rows})


def exact_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, a): n-grams of one to LONGEST words that occur ``least`` times; size 0 has all words of a lang."""
    passed = texts.sparkSession.sparkContext.broadcast(survivors(texts, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, langs in grams_of(batches):
            doc = grams.words.doc
            pick = np.flatnonzero(passed.value.passes(grams.key))
            key, check = grams.key[pick], grams.check(pick)
            by = np.lexsort((check, key))
            order, key, check = pick[by], key[by], check[by]
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]) if len(order) else np.zeros(0, np.int64)
            one = order[head]
            coded = langs.dictionary_encode()
            names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            words = np.bincount(index[doc], minlength=len(names)) if len(doc) else np.zeros(len(names), np.int64)
            lang = pa.concat_arrays([langs.take(pa.array(doc[grams.first[one]])), pa.array(names, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    lang,
                    pa.array(np.r_[grams.size[one], np.zeros(len(names), np.int64)], pa.int32()),
                    pa.concat_arrays([grams.phrases(one), pa.array([""] * len(names), pa.string())]),
                    pa.array(np.r_[np.diff(np.r_[head, len(order)]), words], pa.int64()),
                ],
                ["lang", "size", "phrase", "a"],
            )

    counted = texts.mapInArrow(count, "lang string, size int, phrase string, a long")
    sums = counted.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))
    return saved(sums.where((F.col("a") >= least) | (F.col("size") == 0)), "phrase-counts")


def collocations(
    documents: DataFrame, least: int = LEAST, top: int = TOP, counts: Callable[[DataFrame, int], DataFrame] = exact_counts
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words by score.

    ``documents`` needs text and lang. Words are what blanks and tabs part
    within a piece, pieces what ``.,;:!?`` and line ends part; A-Z count as
    small letters. A phrase that occurs ``least`` times (1 to 255) scores
    floor(10**6 * a * a / (l * r)) at the cut with the lowest score (ties: the
    earliest). One that lies inside a longer such phrase with at least half of
    its occurrences is left out. Ties go by a, then by the phrase's bytes.

    Null texts count as empty, a null lang as 'und'; repeated rows count each.
    No other column is read. An empty table, and languages without such a
    phrase, give no rows. a, l and r below 10**16 are exact.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must lie between 1 and 255")
    found = counts(prepared(documents), least)
    known = found.where(F.col("size") > 0)
    total = found.where(F.col("size") == 0).select("lang", F.col("a").alias("n"))
    candidates = known.where(F.col("size") > 1)

    # A phrase's cuts, each side's count by a join on the words.
    words = F.split("phrase", " ")
    side = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda side, count: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cut = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(cut.alias("cut"))

    # The longer candidates that hold a phrase: drop one word at either end.
    inner = F.explode(F.array(side(F.lit(1), F.col("size") - 1), side(F.lit(2), F.col("size") - 1)))
    longer = candidates.where(F.col("size") > 2).select("lang", inner.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.lit(100) * F.col("cover") < F.lit(COVER_PERCENT) * F.col("a"))
    )
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # The best of each slice first, so that no task sorts all phrases of a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = ranked.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= top).drop("rank")
    whole = Window.partitionBy("lang").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    # All words of a language join what is left, so no task gets a language's candidates.
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 * a * a / (left * right)), in 38-digit arithmetic."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(32,0)"), wide(left) * wide(right))
