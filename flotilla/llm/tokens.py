"""Token counts of a byte-level BPE by rank-synchronous merging over numpy arrays.

A text is cut at the special strings and by the tokenizer's pre-token
pattern. All pre-tokens of a group of documents that were not met before are
laid end to end in one array of symbol ids (a ragged array: symbols plus the
sequence each belongs to). One round looks up the merge rank of every
adjacent pair, takes the lowest rank of every sequence and applies that pair
at all its places in the sequence at once; a pair's new symbol only forms
pairs of a later rank, so rounds give the same symbols as one merge at a
time. Sequences without a mergeable pair leave the array. What is counted
per pre-token is remembered per Python worker in a table of bounded size.

Memory of a task is bounded by one Arrow batch plus the arrays of one group
of documents (``GROUP_CHARS``), not by the table. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The byte-level pre-token pattern of this family of tokenizers (fixed value).
# \p{White_Space} rather than \s: the regex module's \s also takes \x1c-\x1f.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

GROUP_CHARS = 2_000_000
CACHE_TOKENS = 400_000
CACHE_CHARS = 40
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte.

    Rule: printable Latin-1 bytes stand for themselves, the others take the
    characters from code point 256 on, in byte order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            out[chr(extra)] = b
            extra += 1
    return out


class Merges:
    """Merge table: sorted pair keys, their ranks and the symbols they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.start = np.zeros(256, np.int64)
        for ch, b in byte_symbols().items():
            self.start[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


def count_symbols(merges: Merges, pieces: list[bytes]) -> np.ndarray:
    """Symbols left of each byte string after all merges, by rank-synchronous rounds."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = lens.copy()
    sym = merges.start[np.frombuffer(b"".join(pieces), np.uint8)]
    seq = np.repeat(np.arange(len(pieces)), lens)
    while len(sym):
        rank = np.full(len(sym), NO_RANK, np.int64)  # of the pair (i, i + 1)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = merges.pair_ranks(sym[inside], sym[inside + 1])
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        low = np.minimum.reduceat(rank, first)
        done = low == NO_RANK
        counts[seq[first[done]]] = size[done]
        if done.all():
            break
        hit = (rank == np.repeat(low, size)) & (rank != NO_RANK)
        # In a run of one symbol the pairs overlap: every second one, from the left.
        idx = np.arange(len(sym))
        run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], idx, 0))
        hit &= (idx - run) % 2 == 0
        at = np.flatnonzero(hit)
        sym[at] = merges.made[rank[at]]
        keep = ~np.repeat(done, size)
        keep[at + 1] = False
        sym, seq = sym[keep], seq[keep]
    return counts


class Counter:
    """Counts tokens of texts; remembers the counts of short pre-tokens, up to ``CACHE_TOKENS``."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.find = regex.compile(PATTERN).findall

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text``, and how many special strings it holds (one token each)."""
        specials, parts = 0, [text]
        for s in self.merges.specials:
            cut = [p.split(s) for p in parts]
            specials += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return [t for p in parts for t in self.find(p)], specials

    def count(self, texts: list[str]) -> list[int]:
        found = [self.pieces(t) for t in texts]
        if len(self.known) > CACHE_TOKENS:
            self.known = {}
        new = list(set().union(*(p for p, _ in found)) - self.known.keys())
        known = self.known
        if new:
            now = dict(zip(new, count_symbols(self.merges, [t.encode() for t in new]).tolist(), strict=True))
            known.update((t, n) for t, n in now.items() if len(t) <= CACHE_CHARS)
            long = {t: n for t, n in now.items() if len(t) > CACHE_CHARS}
            if long:
                return [sum(known[t] if t in known else long[t] for t in p) + s for p, s in found]
        return [sum(map(known.__getitem__, p)) + s for p, s in found]


def groups(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths add up to about ``limit``, one row at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``documents`` (doc_id, text).

    ``tokenizer_path`` names a byte-level BPE vocabulary file (.json); it is
    read on the driver and its merge table (about 1 MB) goes with the tasks.
    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows, null
    ids and extra columns change nothing: each row is counted by itself. An
    empty table gives no rows.
    """
    merges = Merges(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            tokens: list[int] = []
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in groups(sizes, GROUP_CHARS):
                tokens += counter.count(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
