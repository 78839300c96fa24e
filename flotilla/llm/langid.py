"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters. Each word has affix features (first and last one to
three bytes), character n-grams (two and three bytes) and a lexicon feature
(the whole word); all are hashed into one weight table with a column per
language. Together with learned transitions the weights are fitted by gradient
steps on the log-likelihood of word sequences, whose gradient comes from
forward-backward. Training sequences are made code-switched: spans of documents
in different languages follow each other. Every labelled language is learned.
The bound of the fit: at most ``TRAIN_DOCS`` documents per language and about
``TRAIN_TOTAL`` in all, of which a longer one gives a span of TRAIN_CHARS
characters whose place a hash picks; nothing else is sampled. With very many
languages the features share fewer rows of the weight table, which never holds
more than ``WEIGHTS`` numbers.

Prediction reads whole texts. Words go in sequences of up to SEQUENCE words,
all sequences of a group of documents run side by side through scaled
forward-backward, and a document's language is the one with the largest mean
marginal over its words; ``word_languages`` gives the words' own labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LETTERS, PIECE, Words, find_words, fold_latin, mix, text_groups

TRAIN_DOCS = 300
TRAIN_TOTAL = 60_000
TRAIN_CHARS = 20_000
BUCKETS = 1 << 16
WEIGHTS = 1 << 24
SEQUENCE = 256
# Words whose features the fit makes at a time.
FEATURE_WORDS = 20_000
UNDETERMINED = "und"
EPOCHS = 4
BATCH = 64
STEP = 0.3
TRAIN_WORDS = 40
SEED = 7


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray
    start: np.ndarray


def unique_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(position of one occurrence of each distinct word, number of each word's distinct word)."""
    _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return at, inverse


def buckets_for(languages: int) -> int:
    """Rows of the weight table (a power of two): BUCKETS, or what WEIGHTS leaves for so many languages."""
    return min(BUCKETS, 1 << max(8, (WEIGHTS // max(1, languages)).bit_length() - 1))


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers (below ``buckets``) of words end to end, and where each word's begin."""
    n = end - start
    pad = np.r_[data, np.zeros(4, np.uint8)].astype(np.uint64)
    words = np.arange(len(start))
    owner, codes = [], []

    def add(rows: np.ndarray, kind: int, value: np.ndarray) -> None:
        owner.append(rows)
        codes.append(mix(value * np.uint64(64) + np.uint64(kind)) & np.uint64(buckets - 1))

    for k in (1, 2, 3):  # prefixes and suffixes
        rows = words[n >= k]
        head = sum(pad[start[rows] + i] << np.uint64(8 * i) for i in range(k))
        tail = sum(pad[end[rows] - k + i] << np.uint64(8 * i) for i in range(k))
        add(rows, k, head)
        add(rows, 8 + k, tail)
    for k in (2, 3):  # n-grams
        size = np.maximum(n - k + 1, 0)
        rows = np.repeat(words, size)
        at = start[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        add(rows, 16 + k, sum(pad[at + i] << np.uint64(8 * i) for i in range(k)))
    # Lexicon: the whole word, by a polynomial over its bytes.
    size = np.minimum(n, 24)
    rows = np.repeat(words, size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    value = (pad[start[rows] + place] + np.uint64(1)) * mix(place.astype(np.uint64) + np.uint64(77))
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, rows, value)
    add(words, 32, whole)
    owners, numbers = np.concatenate(owner).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    return numbers[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def chunked_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words, some at a time, so that little more than the result is held at once."""
    numbers, sizes = [], []
    for a in range(0, len(start), FEATURE_WORDS):
        s, e = start[a : a + FEATURE_WORDS], end[a : a + FEATURE_WORDS]
        low, high = int(s.min()), int(e.max())  # the bytes of these words only
        n, begin = features(data[low:high], s - low, e - low, buckets)
        numbers.append(n)
        sizes.append(np.diff(begin))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int32), np.r_[0, np.cumsum(size)]


def emissions(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Score of every language for each word."""
    if not len(start):
        return np.zeros((0, len(model.languages)), np.float32)
    numbers, begin = features(data, start, end, len(model.weights))
    return np.add.reduceat(model.weights[numbers], begin[:-1], axis=0)


def forward_backward(scores: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Marginals of every word; ``first`` marks where sequences begin (and the end).

    All sequences advance together, longest first, so that step t works on a
    leading part of them.
    """
    total, labels = scores.shape
    out = np.empty((total, labels), np.float32)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    psi = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))
    step, initial = np.exp(model.transitions), np.exp(model.start)
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than t
    alpha = None
    for t in range(steps):
        m = alive[t]
        at = begin[:m] + t
        alpha = initial * psi[at] if t == 0 else (alpha[:m] @ step) * psi[at]
        alpha = alpha / alpha.sum(axis=1, keepdims=True)
        out[at] = alpha
    beta = np.ones((len(begin), labels), np.float32)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        here = beta[:m]
        both = out[at] * here
        out[at] = both / both.sum(axis=1, keepdims=True)
        new = (here * psi[at]) @ step.T
        beta[:m] = new / new.sum(axis=1, keepdims=True)
    return out


def pair_expectations(scores: np.ndarray, gold: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of sequences of one length (rows x steps x labels) by score, transition, start."""
    rows, steps, labels = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, initial = np.exp(model.transitions), np.exp(model.start)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for t in range(steps):
        a = initial * psi[:, 0] if t == 0 else (alpha[:, t - 1] @ step) * psi[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * psi[:, t + 1]) @ step.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    node = alpha * beta
    node /= node.sum(axis=2, keepdims=True)
    expected, moves = np.zeros((labels, labels)), np.zeros((labels, labels))
    for t in range(1, steps):
        # A row's pairs are (from x step x onto) / total; their sum over the rows is one matrix product.
        origin, onto = alpha[:, t - 1], psi[:, t] * beta[:, t]
        total = ((origin @ step) * onto).sum(axis=1, keepdims=True)
        expected += (origin / total).T @ onto
        np.add.at(moves, (gold[:, t - 1], gold[:, t]), 1)
    score = -node
    score[np.arange(rows)[:, None], np.arange(steps), gold] += 1
    return score, moves - expected * step, score[:, 0].sum(axis=0)


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit the field on code-switched word sequences made of labelled texts."""
    languages = sorted(set(labels))
    count = len(languages)
    buckets = buckets_for(count)
    model = Model(languages, np.zeros((buckets, count), np.float32), np.zeros((count, count)), np.zeros(count))
    if count < 2:
        return model
    rng = np.random.default_rng(SEED)
    # Features are made once for each distinct word, so the driver holds few of them.
    pools: list[list[np.ndarray]] = [[] for _ in languages]
    place = {name: i for i, name in enumerate(languages)}
    datas, starts, ends, hashes, base, shift = [], [], [], [], 0, 0
    for text, label in zip(texts, labels, strict=True):
        for _, _, data, offsets in text_groups(pa.array([text])):
            data = fold_latin(data)
            w = find_words(data, offsets, LETTERS, fold=False)
            datas.append(data)
            starts.append(w.start + shift)
            ends.append(w.end + shift)
            hashes.append(w.hash)
            pools[place[label]].append(np.arange(base, base + len(w.start)))
            base, shift = base + len(w.start), shift + len(data)
    _, at, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    # Distinct words in the order of the texts, so that a chunk's bytes lie together.
    place_of = np.argsort(at)
    at, renumbered = at[place_of], np.empty_like(place_of)
    renumbered[place_of] = np.arange(len(place_of))
    number = renumbered[number]
    numbers, begin = chunked_features(np.concatenate(datas), np.concatenate(starts)[at], np.concatenate(ends)[at], buckets)
    pools = [number[np.concatenate(p)] for p in pools]
    usable = np.array([i for i in range(count) if len(pools[i])])
    if len(usable) < 2:
        return model
    squares = np.full((buckets, count), 1e-6, np.float32)
    t_squares, s_squares = np.full((count, count), 1e-6), np.full(count, 1e-6)
    sequences = EPOCHS * max(400, min(4000, base // TRAIN_WORDS), 20 * count)
    for _ in range(max(1, sequences // BATCH)):
        rows = np.empty((BATCH, TRAIN_WORDS), np.int64)
        gold = np.empty((BATCH, TRAIN_WORDS), np.int64)
        for r in range(BATCH):
            at = 0
            while at < TRAIN_WORDS:
                take = min(TRAIN_WORDS - at, int(rng.integers(5, TRAIN_WORDS + 1)))
                lang = int(rng.choice(usable))
                pool = pools[lang]
                take = min(take, len(pool))
                where = int(rng.integers(0, len(pool) - take + 1))
                rows[r, at : at + take] = pool[where : where + take]
                gold[r, at : at + take] = lang
                at += take
        flat = rows.ravel()
        size = begin[flat + 1] - begin[flat]
        owner = np.repeat(np.arange(len(flat)), size)
        index = numbers[np.repeat(begin[flat] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(owner))]
        heads = np.r_[0, np.cumsum(size)[:-1]]
        scores = np.add.reduceat(model.weights[index], heads, axis=0).reshape(BATCH, TRAIN_WORDS, count)
        by_score, by_move, by_start = pair_expectations(scores, gold, model)
        grad = np.zeros((buckets, count), np.float32)
        per = by_score.reshape(-1, count)
        for c in range(count):
            grad[:, c] = np.bincount(index, weights=per[owner, c], minlength=buckets) / BATCH
        squares += grad**2
        model.weights += STEP * grad / np.sqrt(squares)
        by_move, by_start = by_move / BATCH, by_start / BATCH
        t_squares += by_move**2
        s_squares += by_start**2
        model.transitions += STEP * by_move / np.sqrt(t_squares)
        model.start += STEP * by_start / np.sqrt(s_squares)
    # Only nearly unseen features are left at almost zero; keep the table in half the memory.
    model.weights = model.weights.astype(np.float16).astype(np.float32)
    return model


def training_sample(documents: DataFrame, folds: int, held_out: int) -> list[tuple[str, str]]:
    """(text, lang) of at most TRAIN_DOCS documents of every language, chosen by a hash of the row.

    A text of more than TRAIN_CHARS characters gives a span of that length
    whose place the hash picks.
    """
    rows = documents.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & (F.col("text") != "")
        & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != held_out)
    )
    names = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not names:
        return []
    most = max(1, min(TRAIN_DOCS, TRAIN_TOTAL // len(names)))
    # A language's documents are thinned by hash to a few times the bound, so the last cut is small.
    share = F.create_map(*[F.lit(x) for r in names for x in (r.lang, min(1.0, (3.0 * most + 30) / r.n))])
    by = F.xxhash64("doc_id", "text")
    part = (F.pmod(by, F.lit(1_000_003)) / 1_000_003.0) <= F.element_at(share, F.col("lang"))
    spare = F.greatest(F.length("text") - F.lit(TRAIN_CHARS), F.lit(0))
    span = F.substring(F.col("text"), F.pmod(F.xxhash64(by, F.lit(1)), spare + 1).cast("int") + 1, F.lit(TRAIN_CHARS))
    picked = rows.where(part).select("lang", F.struct(by.alias("by"), span.alias("text")).alias("one"))
    picked = picked.groupBy("lang").agg(F.sort_array(F.collect_list("one")).alias("all"))
    picked = picked.select("lang", F.explode(F.slice("all", 1, most)).alias("one")).select("one.text", "lang")
    return [(r.text, r.lang) for r in picked.orderBy("lang", "text").collect()]


def marginals(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of the texts of one group and the probability of every language for each word."""
    data = fold_latin(data)
    w = find_words(data, offsets, LETTERS, fold=False)
    at, inverse = unique_words(w)
    scores = emissions(model, data, w.start[at], w.end[at])[inverse]
    new = np.r_[True, w.doc[1:] != w.doc[:-1]] if len(w.doc) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    place = np.arange(len(w.doc)) - np.repeat(heads, np.diff(np.r_[heads, len(w.doc)]))
    first = np.r_[np.flatnonzero(place % SEQUENCE == 0), len(w.doc)]
    return w, forward_backward(scores, first, model)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents`` (doc_id, text)."""
    names = np.array([*model.languages, UNDETERMINED], object)
    count = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1), PIECE):
                best, score = np.full(b - a, count), np.zeros(b - a)
                if count:
                    w, p = marginals(model, data, offsets)
                    mean = np.stack([np.bincount(w.doc, p[:, c], b - a).astype(float) for c in range(count)], axis=1)
                    words = np.bincount(w.doc, minlength=b - a)
                    some = words > 0
                    # Non-ASCII bytes count as letters above; texts without an ASCII letter are looked at closely.
                    ascii_letter = np.bincount(
                        np.searchsorted(offsets, np.flatnonzero(LETTERS[data] & (data < 128)), "right") - 1, minlength=b - a
                    )
                    texts = batch.column(1)
                    for i in np.flatnonzero(some & (ascii_letter[: b - a] == 0)):
                        some[i] = any(ch.isalpha() for ch in texts[a + int(i)].as_py())
                    mean[some] /= words[some, None]
                    best[some] = mean[some].argmax(axis=1)
                    score[some] = np.clip(mean[some].max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def word_languages(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of every word of one text, by its marginals."""
    flat = pa.array([text])
    out = []
    for _, _, data, offsets in text_groups(flat):
        w, p = marginals(model, data, offsets)
        raw = data.tobytes()
        best = p.argmax(axis=1) if len(p) else []
        out += [(raw[s:e].decode(errors="replace"), model.languages[i]) for s, e, i in zip(w.start, w.end, best, strict=True)]
    return out


def identify(documents: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents`` (doc_id, text, lang).

    Learns from text and non-null lang of the rows whose crc32(doc_id as text)
    mod ``folds`` is not ``held_out`` (a null id counts as empty text). Null
    texts and texts without a letter are 'und' with score 0; so is everything
    if no labelled text is there to learn from. With one known language every
    text with letters gets it. Rows that repeat are predicted each; an empty
    table gives no rows.
    """
    sample = training_sample(documents, folds, held_out)
    model = train([t for t, _ in sample], [g for _, g in sample])
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    return predict(documents, model).select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
