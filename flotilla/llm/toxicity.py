"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: a hashed word embedding plus the mean of its hashed character
trigram embeddings. Two gated recurrent layers read a window of words forwards
and backwards, attention over the steps pools them, and a linear layer gives
the window's logit. Texts are cut into overlapping windows (WINDOW words every
STRIDE) and every window is scored; a document's score is the calibrated
largest window logit.

Training (backpropagation through time, Adam) takes document labels: window
logits of a document are pooled by log-sum-exp, so the gradient finds the
windows that carry the label. The bound of the fit: at most TRAIN_DOCS
documents a class, picked by a hash of the id; of one longer than SAMPLE_CHARS
characters a span of that length, whose place a hash picks. A training step
takes a random span of TRAIN_CHARS characters of a text, the calibration reads
the sampled texts whole. Scoring reads every whole text, in tasks whose memory
is bounded by one group of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import LETTERS_DIGITS, PIECE, Words, find_words, fold_latin, mix, text_groups

WINDOW = 40
STRIDE = 20
HIDDEN = 8
INPUT = 10
WORD_BUCKETS = 1 << 16
CHAR_BUCKETS = 1 << 12
TRAIN_DOCS = 1500
TRAIN_CHARS = 6_000
SAMPLE_CHARS = 40_000
BATCH_DOCS = 48
# Training batches: some for any sample, more for larger ones.
STEPS = 120
MORE_STEPS = 180
RATE = 0.01
# Words of fewer training documents have no word embedding, only their characters';
# those of fewer than TRAINED_TEXTS keep the start of theirs.
LEAST_TEXTS = 5
TRAINED_TEXTS = 12
DROP = 0.1
SEED = 11

Arrays = dict[str, np.ndarray]


@dataclass
class Model:
    """Network weights and the calibration (slope, offset) of the largest window logit."""

    weights: Arrays = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None  # the score of every text where nothing could be learned


def new_weights() -> Arrays:
    rng = np.random.default_rng(SEED)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {"word": np.zeros((WORD_BUCKETS, INPUT), np.float32), "char": normal(CHAR_BUCKETS, INPUT, scale=0.1)}
    for side in ("f", "b"):
        w[f"x_{side}"] = normal(INPUT, 3 * HIDDEN, scale=INPUT**-0.5)
        w[f"h_{side}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        w[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    w["attention"] = normal(2 * HIDDEN, scale=0.5)
    w["out"] = normal(2 * HIDDEN, scale=0.5)
    w["out_bias"] = np.full(1, -2.0, np.float32)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of words (with their edges) end to end, and where each word's begin."""
    n = end - start
    begin = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    at = start[word] + np.arange(len(word)) - begin[word]
    bytes_ = data.astype(np.uint64)
    left = np.where(at > start[word], bytes_[np.maximum(at - 1, 0)], 0)
    right = np.where(at + 1 < end[word], bytes_[np.minimum(at + 1, len(data) - 1)], 0)
    code = (left << np.uint64(16)) | (bytes_[at] << np.uint64(8)) | right
    return (mix(code + np.uint64(1)) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64), begin


def word_inputs(w: Arrays, buckets: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Input vector of each distinct word."""
    if not len(buckets):
        return np.zeros((0, INPUT), np.float32)
    size = np.diff(np.r_[begin, len(grams)])[:, None]
    return w["word"][buckets] + np.add.reduceat(w["char"][grams], begin, axis=0) / size


def window_table(words: Words, number: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct-word numbers of every window, its document); places beyond a text hold ``none``.

    Windows start every STRIDE words until the text's last word is covered; a
    text without words has none.
    """
    count = np.bincount(words.doc, minlength=words.docs)
    first = np.cumsum(count) - count
    wins = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(words.docs), wins)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(wins) - wins, wins)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    inside = at < count[doc][:, None]
    return np.where(inside, np.r_[number, none][np.where(inside, first[doc][:, None] + at, len(number))], none), doc


def run_side(w: Arrays, side: str, projected: np.ndarray, table: np.ndarray, real: np.ndarray, keep: bool):
    """States of one direction, steps x windows x HIDDEN, in text order; with ``keep`` what backpropagation needs."""
    steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    h = np.zeros((len(table), HIDDEN), np.float32)
    u = w[f"h_{side}"]
    states = np.empty((WINDOW, len(table), HIDDEN), np.float32)
    tape = []
    whole = real.all(axis=0)
    for t in steps:
        x = projected[table[:, t]]
        g = h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if not whole[t]:
            new = np.where(real[:, t, None], new, h)
        if keep:
            tape.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
        h = new
        states[t] = h
    return states, tape


def forward(w: Arrays, inputs: np.ndarray, table: np.ndarray, keep: bool = False):
    """Logit of every window; with ``keep`` also what backpropagation needs."""
    real = table < len(inputs)
    sides = {}
    for side in ("f", "b"):
        projected = np.r_[inputs @ w[f"x_{side}"] + w[f"bias_{side}"], np.zeros((1, 3 * HIDDEN), np.float32)]
        sides[side] = run_side(w, side, projected, table, real, keep)
    states = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
    energy = np.where(real.T, states @ w["attention"], -1e9)
    share = np.exp(energy - energy.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    logit = pooled @ w["out"] + w["out_bias"][0]
    return logit, (states, share, pooled, real, sides) if keep else None


def sums_by(number: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``number``, below ``size``."""
    return np.stack([np.bincount(number, values[:, c], size) for c in range(values.shape[1])], axis=1).astype(np.float32)


def backward(w: Arrays, inputs: np.ndarray, table: np.ndarray, kept, d_logit: np.ndarray) -> tuple[Arrays, np.ndarray]:
    """Gradients of the weights (embeddings aside) and of the distinct words' inputs."""
    states, share, pooled, real, sides = kept
    grad = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["out"]
    d_share = np.einsum("nh,tnh->tn", d_pooled, states)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    grad["attention"] = np.einsum("tn,tnh->h", d_energy, states)
    d_states = share[:, :, None] * d_pooled + d_energy[:, :, None] * w["attention"]
    d_inputs = np.zeros((len(inputs) + 1, INPUT), np.float32)
    for k, side in enumerate(("f", "b")):
        u = w[f"h_{side}"]
        d_u = np.zeros_like(u)
        d_steps = np.empty((WINDOW, len(table), 3 * HIDDEN), np.float32)
        d_h = np.zeros((len(table), HIDDEN), np.float32)
        for t, h, z, r, n, g in reversed(sides[side][1]):
            d_h = d_h + d_states[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            live = real[:, t, None]
            d_new = np.where(live, d_h, 0)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * g * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], axis=1)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += h.T @ d_g
            d_steps[t] = d_x
            d_h = np.where(live, d_new * z + d_g @ u.T, d_h)
        d_projected = sums_by(table.T.ravel(), d_steps.reshape(-1, 3 * HIDDEN), len(inputs) + 1)[:-1]
        grad[f"h_{side}"] = d_u
        grad[f"x_{side}"] = inputs.T @ d_projected
        grad[f"bias_{side}"] = d_projected.sum(axis=0)
        d_inputs[:-1] += d_projected @ w[f"x_{side}"].T
    return grad, d_inputs[:-1]


@dataclass
class Prepared:
    """Windows of a group of texts over its distinct words."""

    buckets: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    table: np.ndarray
    doc: np.ndarray


def prepare(data: np.ndarray, offsets: np.ndarray) -> Prepared:
    data = fold_latin(data)
    words = find_words(data, offsets, LETTERS_DIGITS, fold=False)
    hashes, at, number = np.unique(words.hash, return_index=True, return_inverse=True)
    grams, begin = trigrams(data, words.start[at], words.end[at])
    table, doc = window_table(words, number, len(at))
    return Prepared((hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), grams, begin, table, doc)


def best_logits(w: Arrays, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest window logit of every text; -inf for texts without words."""
    p = prepare(data, offsets)
    inputs = word_inputs(w, p.buckets, p.grams, p.begin)
    best = np.full(len(offsets) - 1, -np.inf)
    for a in range(0, len(p.table), 4096):  # bounds the states held at once
        logit, _ = forward(w, inputs, p.table[a : a + 4096])
        np.maximum.at(best, p.doc[a : a + 4096], logit)
    return best


def log_odds(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of the first embedding column, whether a bucket is trained) of every word bucket.

    The start is the smoothed log odds of a training text with the word being
    toxic, against all; buckets of fewer than LEAST_TEXTS texts start at 0.
    """
    counts = np.zeros((2, WORD_BUCKETS))
    at = 0
    for a, b, data, offsets in text_groups(pa.array(texts)):
        words = find_words(fold_latin(data), offsets, LETTERS_DIGITS, fold=False)
        pairs = np.unique(words.doc * WORD_BUCKETS + (words.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64))
        label = y[at + pairs // WORD_BUCKETS].astype(np.int64)
        np.add.at(counts, (label, pairs % WORD_BUCKETS), 1)
        at += b - a
    share = (counts + 1) / (np.array([[np.sum(y == 0)], [np.sum(y == 1)]]) + 2)
    texts_with = counts.sum(axis=0)
    start = np.where(texts_with >= LEAST_TEXTS, np.log(share[1] / share[0]), 0)
    return start.astype(np.float32), texts_with >= TRAINED_TEXTS


def span(text: str, rng: np.random.Generator) -> str:
    """A random span of TRAIN_CHARS characters; a shorter text whole."""
    spare = len(text) - TRAIN_CHARS
    at = int(rng.integers(0, spare + 1)) if spare > 0 else 0
    return text[at : at + TRAIN_CHARS]


def train(texts: list[str], labels: list[int], toxic_share: float | None = None) -> Model:
    """Fit the network on labelled texts; ``toxic_share``: of all labelled texts, if these are not a fair sample."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    w, rng = new_weights(), np.random.default_rng(SEED)
    first: Arrays = {k: np.zeros_like(v) for k, v in w.items()}
    second: Arrays = {k: np.zeros_like(v) for k, v in w.items()}
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w["word"][:, 0], known = log_odds(texts, y)
    steps = STEPS + min(MORE_STEPS, len(y) // 16)
    for step in range(1, steps + 1):
        half = BATCH_DOCS // 2
        chosen = np.r_[rng.choice(ones, half), rng.choice(zeros, BATCH_DOCS - half)]
        flat = pa.array([span(texts[i], rng) for i in chosen])
        ((_, _, data, offsets),) = list(text_groups(flat, 1 << 40))
        p = prepare(data, offsets)
        inputs = word_inputs(w, p.buckets, p.grams, p.begin)
        # Dropped words leave a gap the network reads over.
        gone = rng.random(p.table.shape) < DROP
        gone[:, 0] = False
        logit, kept = forward(w, inputs, np.where(gone, len(inputs), p.table), keep=True)
        # Documents' logits: log-sum-exp over their windows.
        top = np.full(len(chosen), -30.0, np.float32)
        np.maximum.at(top, p.doc, logit)
        e = np.exp(logit - top[p.doc])
        total = np.bincount(p.doc, e, len(chosen)) + 1e-9
        error = sigmoid(top + np.log(total)) - y[chosen]
        d_logit = (error[p.doc] * e / total[p.doc] / len(chosen)).astype(np.float32)
        grad, d_inputs = backward(w, inputs, np.where(gone, len(inputs), p.table), kept, d_logit)
        size = np.diff(np.r_[p.begin, len(p.grams)])
        grad["word"] = sums_by(p.buckets, d_inputs * known[p.buckets, None], WORD_BUCKETS)
        grad["char"] = sums_by(p.grams, np.repeat(d_inputs / size[:, None], size, axis=0), CHAR_BUCKETS)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            touched = np.flatnonzero(g.any(axis=1)) if k in ("word", "char") else slice(None)
            g = g[touched]
            first[k][touched] = 0.9 * first[k][touched] + 0.1 * g
            second[k][touched] = 0.99 * second[k][touched] + 0.01 * g * g
            up = first[k][touched] / (1 - 0.9**step) / (np.sqrt(second[k][touched] / (1 - 0.99**step)) + 1e-6)
            w[k][touched] -= (rate * up).astype(np.float32)
    w["word"] = w["word"].astype(np.float16)  # half the bytes to send; rows never trained are zero
    best = np.concatenate([best_logits(w, data, offsets) for _, _, data, offsets in text_groups(pa.array(texts))])
    share = float(y.mean()) if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, offset = calibrate(np.clip(best, -30, 30), y, weight)
    return Model(w, slope, offset)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the label by logit, by Newton's method with a ridge towards (1, 0)."""
    design, theta, prior = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(np.clip(design @ theta, -30, 30))
        gradient = design.T @ (weight * (y - p)) - 0.1 * (theta - prior)
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, gradient)
    return max(float(theta[0]), 1e-3), float(theta[1])


def training_sample(documents: DataFrame, labels: DataFrame, folds: int, held_out: int) -> tuple[list[tuple[str, int]], float]:
    """(text, toxic) of at most TRAIN_DOCS labelled documents a class, chosen by a hash of the id; the share of toxic ones in all."""
    known = labels.where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    )
    known = known.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("i"), "i"]
    # Ids of documents that have a text, so that the bound is not spent on others.
    texts = documents.where(F.col("text") != "").select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"))
    known = saved(known.join(texts.select("i"), "i", "left_semi"), "toxic-labels")
    picked = [known.where(F.col("toxic") == c).orderBy(*order).limit(TRAIN_DOCS) for c in (1, 0)]
    share = known.agg(F.avg("toxic")).first()[0]
    spare = F.greatest(F.length("text") - F.lit(SAMPLE_CHARS), F.lit(0))
    cut = F.substring(F.col("text"), F.pmod(F.xxhash64("i", "text"), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = texts.join(picked[0].unionByName(picked[1]), "i").select("i", cut.alias("text"), "toxic")
    # Rows that repeat an id count as one labelled document, the first text in order.
    rows = rows.groupBy("i", "toxic").agg(F.min("text").alias("text")).orderBy("toxic", *order).collect()
    return [(r.text, int(r.toxic)) for r in rows], float(share or 0.0)


def score_documents(documents: DataFrame, model: Model, folds: int, held_out: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1), PIECE):
                if model.constant is None:
                    best = np.clip(best_logits(model.weights, data, offsets), -30, 30)
                    score = sigmoid(np.clip(model.slope * best + model.offset, -30, 30))
                else:
                    score = np.full(b - a, model.constant)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(score, pa.float64())], ["doc_id", "score"]
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) of the rows whose crc32(doc_id as
    text) mod ``folds`` is not ``held_out``; labels other than 0 and 1 and null
    ids are passed over, and a doc_id labelled twice is toxic if any label
    says so. Null texts and texts without a word get the lowest score. Without
    labels of both classes every score is the labels' mean (0 if there are
    none). Long labelled texts give spans, so they are learned from, too; a
    label whose document has no text is no example. Rows that repeat are scored each; an empty table gives no rows.
    """
    sample, share = training_sample(documents, labels, folds, held_out)
    model = train([t for t, _ in sample], [y for _, y in sample], share)
    return score_documents(documents, model, folds, held_out)
