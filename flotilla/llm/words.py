"""Words of many texts as numpy arrays: boundaries and 64-bit hashes, straight from Arrow's UTF-8 bytes.

A word's hash is a polynomial over per-byte random values, taken from prefix
sums modulo 2**64, then mixed. Text is worked on in pieces of ``PIECE`` bytes
cut between words, so the arrays stay small whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

BYTES = np.arange(256)
ASCII_FOLD = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
# Words between space and \t..\r, as in the contracts of the deduplicating operators.
NON_SPACE = ~((BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13)))
# Runs of ASCII letters and of all bytes of non-ASCII characters.
LETTERS = ((BYTES >= 97) & (BYTES <= 122)) | ((BYTES >= 65) & (BYTES <= 90)) | (BYTES >= 128)
# The same with digits.
LETTERS_DIGITS = LETTERS | ((BYTES >= 48) & (BYTES <= 57))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def powers(size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE**i, BASE**-i for i up to ``size``, and a random value for each byte."""
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.r_[one, np.full(size, BASE)])
    down = np.cumprod(np.r_[one, np.full(size, BASE_INVERSE)])
    return up, down, mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@dataclass
class Words:
    """Words of the texts of one group: byte range in ``data``, hash and text number of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    docs: int


def text_groups(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes, one row at least."""
    flat = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = flat.buffers()
    off = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(flat):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def fold_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters, in UTF-8 bytes."""
    out = ASCII_FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    cap = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[cap] += 0x20
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool = True) -> Words:
    """Words of one group; hashes are of the folded bytes (A-Z only, unless already folded)."""
    up, down, value = powers()
    total = len(data)
    first = np.zeros(total + 1, bool)
    first[offsets] = True
    starts, ends, hashes = [], [], []
    pos = 0
    while pos < total:
        end = min(pos + PIECE, total)
        if end < total:
            cut = np.flatnonzero(~is_word[data[pos:end]] | first[pos:end])
            if len(cut) and cut[-1]:
                end = pos + int(cut[-1])
            else:  # one word fills the piece: on to its end
                stop = ~is_word[data[end:]] | first[end:total]
                end = end + int(stop.argmax()) if stop.any() else total
        part = data[pos:end]
        if len(part) >= len(up):
            up, down, value = powers(1 << len(part).bit_length())
        inside = is_word[part]
        new = first[pos : end + 1]
        before = np.r_[False, inside[:-1]] & ~new[:-1]
        after = np.r_[inside[1:], False] & ~new[1:]
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[ASCII_FOLD[part] if fold else part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * BASE))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = end
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    found = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, found, doc, len(offsets) - 1)
