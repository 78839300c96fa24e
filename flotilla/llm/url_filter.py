"""URL filter: host/path rules, then the ratio of two character language models.

URLs that a rule decides are the models' texts: one variable-order Markov
model of the allowed, one of the blocked. A model of order k predicts a
character from the k before it, smoothed by Witten-Bell interpolation with the
order below (down to a uniform alphabet):
    P_k(c | h) = (n(hc) + types(h) * P_{k-1}(c | h')) / (n(h) + types(h)).
The tables are distributed: counts are aggregates over all decided URLs, and
each distinct (history, character) of any URL gets its log ratio by joins from
the lowest order up. A URL's score is the mean log ratio of its characters;
its characters meet the table in one join on the window, whose hot windows AQE
splits. The cut is a logistic calibration on the decided URLs of a held-out
fold, whose characters the counts leave out: only a histogram of BINS score
bins per class comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

ORDER = 4
FOLDS = 5
ALPHABET = 256.0
BINS = 800
BIN_WIDTH = 0.02
# Padding before the first character of a URL.
PAD = "\x02"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and a path prefix, written ``host/prefix``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or end, A-Z lower-cased; path: then up to '?', '#' or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first in the end
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def scored_part(url: Column) -> Column:
    """What the models read: the URL without its scheme (null: empty)."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return lower_ascii(F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(u))


def windows(text: Column) -> Column:
    """For every character of ``text``, it and the ORDER characters before it (padded)."""

    def cut(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(t) - ORDER), lambda i: F.substr(t, i, F.lit(ORDER + 1)))
        return F.when(F.length(t) > ORDER, each).otherwise(F.array().cast("array<string>"))

    return let(F.concat(F.lit(PAD * ORDER), text), cut)


def log_ratios(counts: DataFrame) -> DataFrame:
    """(w, ratio): log P_blocked - log P_allowed of each distinct window, from (w, allow, block) counts.

    Every window of any URL has a row, with counts 0 where no decided URL
    holds it. One aggregate and two joins per order, all over distinct
    windows, never over occurrences.
    """
    level = counts.select(
        "w", F.substr("w", F.lit(ORDER + 1)).alias("key"),
        F.lit(1.0 / ALPHABET).alias("p_allow"), F.lit(1.0 / ALPHABET).alias("p_block"), "allow", "block",
    )
    grams = level.select("w", "allow", "block")
    probs = level.select("w", "p_allow", "p_block")
    for k in range(ORDER + 1):
        # gram: last k + 1 characters of the window; history: those without the last.
        gram, history = F.substr("w", F.lit(ORDER + 1 - k)), F.substr("w", F.lit(ORDER + 1 - k), F.lit(k))
        n = grams.groupBy(gram.alias("gram")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"))
        n = saved(n.withColumn("history", F.substr("gram", F.lit(1), F.lit(k))), "grams")
        h = n.groupBy("history").agg(
            F.sum("n_allow").alias("h_allow"), F.sum("n_block").alias("h_block"),
            F.count_if(F.col("n_allow") > 0).alias("t_allow"), F.count_if(F.col("n_block") > 0).alias("t_block"),
        )
        both = n.join(h, "history").drop("history")
        level = probs.withColumn("gram", gram).join(both, "gram")

        def p(kind: str) -> Column:
            total = F.col(f"h_{kind}") + F.col(f"t_{kind}")
            value = (F.col(f"n_{kind}") + F.col(f"t_{kind}") * F.col(f"p_{kind}")) / total
            return F.when(total > 0, value).otherwise(F.col(f"p_{kind}"))

        probs = saved(level.select("w", p("allow").alias("p_allow"), p("block").alias("p_block")), "orders")
    return probs.select("w", (F.log("p_block") - F.log("p_allow")).alias("ratio"))


def calibrate(bins: np.ndarray, blocked: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of a block by score, by Newton's method with a small ridge.

    Without held-out URLs of both classes the ratio itself decides: (1, 0).
    """
    if not len(bins) or blocked.sum() == 0 or blocked.sum() == count.sum():
        return 1.0, 0.0
    x, theta = np.c_[bins, np.ones(len(bins))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        gradient = x.T @ (blocked - count * p) - 1e-2 * theta
        hessian = (x * (count * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, block_probability) for every row of ``pages`` (page_id, url).

    A null url, or one without '://', has an empty host and path, so no rule
    fits. URLs without a rule get the model's verdict: block when the
    calibrated probability is above 0.5, allow at a tie. An empty or null url has score 0.
    If the rules decide no URL at all, or all alike, the models know nothing of
    one side: the ratio decides uncalibrated, and 0 means allow. Rows that
    repeat, null ids and other columns change nothing; an empty table gives no
    rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.select("*", rule.alias("rule"), verdict.alias("given"))
    # Rows that repeat a url share its score, so urls are scored once.
    urls = saved(
        judged.groupBy("url").agg(F.first("given").alias("given"), F.count(F.lit(1)).alias("pages"))
        .withColumn("held_out", F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0),
        "urls",
    )
    parts = urls.select("url", "given", "pages", "held_out", F.explode(windows(scored_part(F.col("url")))).alias("w"))

    def decided(kind: str) -> Column:
        return F.sum(F.when((F.col("given") == kind) & ~F.col("held_out"), F.col("pages")).otherwise(0))

    counts = saved(parts.groupBy("w").agg(decided("allow").alias("allow"), decided("block").alias("block")), "windows")
    ratios = saved(log_ratios(counts), "ratios")
    sums = parts.select("url", "w").join(ratios, "w").groupBy("url").agg(F.avg("ratio").alias("score"))
    scores = urls.join(sums.withColumnRenamed("url", "u"), F.col("url").eqNullSafe(F.col("u")), "left")
    scores = saved(scores.select("url", "given", "held_out", "pages", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")

    bin_ = F.least(F.greatest(F.round(F.col("score") / BIN_WIDTH), F.lit(-BINS // 2)), F.lit(BINS // 2))
    shown = (
        scores.where(F.col("held_out") & F.col("given").isNotNull())
        .groupBy(bin_.alias("bin"))
        .agg(F.sum(F.when(F.col("given") == "block", F.col("pages")).otherwise(0)).alias("blocked"), F.sum("pages").alias("n"))
        .orderBy("bin")
        .collect()
    )  # at most BINS + 1 rows
    slope, offset = calibrate(*(np.array([float(r[i]) for r in shown]) for i in range(3))) if shown else (1.0, 0.0)
    if shown:
        slope, offset = slope / BIN_WIDTH, offset
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(offset))))
    model = F.when(F.col("score") * slope + offset > 0, F.lit("block")).otherwise(F.lit("allow"))
    scored = scores.select(F.col("url").alias("u"), "score", chance.alias("block_probability"), model.alias("model"))
    out = judged.join(scored, F.col("url").eqNullSafe(F.col("u")), "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("given", "model").alias("verdict"), "score", "block_probability"
    )
