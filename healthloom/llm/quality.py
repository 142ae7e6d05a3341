"""Quality classifier: document evidence and site posteriors, hierarchical empirical Bayes.

Evidence is a logistic model over a few measures of the whole text and its
hashed words: the square roots of the shares of ``BUCKETS`` hashed words and of
as many hashed pairs of words.  It is fitted by Newton's method on at most
``SAMPLE_ROWS`` labelled rows (those whose hashed id is least).  Sites are hosts
(``source``) and paths within them (``lang`` stands for the path in this table).
One grouped aggregation gives, per path, the number of documents and the sum and
sum of squares of their evidence; hosts and the whole are sums of that.  Prior
strengths come from the moments: how much more the sites' means vary than
documents alone would make them.  A path is shrunk towards its host, a host
towards the whole, so sparse sites stay near what is known of larger ones.  A
document's own evidence is taken out of its site before the site speaks about it.

    posterior logit = evidence logit + weight * (path logit - global logit)

Documents with a posterior of at least ``THRESHOLD`` are kept.

Sums are partial aggregates; the site table is broadcast only after its rows
are counted and joined by a shuffle when there are many.

Defined cases: a null text is empty; a text without words has no shares; a very
long text counts whole; a null source or path is a site of its own; labels of
one class only (or none) make every posterior the prior, and every document is
kept; equal posteriors are judged alike, as are repeated rows; an empty table
gives no rows; other columns are kept by ``keep_good`` and ignored by
``classify``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shipped, small

shipped(__name__)

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
SITE_WEIGHT = 0.5
RIDGE = 1.0
#: Evidence never says more than this (in logits), so no site can be certain.
MOST_LOGIT = 12.0
#: Hashed words, and hashed pairs of words, that are told apart; what their shares are multiplied by.
BUCKETS, SCALE = 64, 2.0
#: Parts of the sample that are added up side by side.
PARTS = 4


def measures(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, each near the unit scale."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t) + 1
    words = F.split(t, r"[\x20\x09-\x0D]+")
    count = F.size(words)
    repeats = 1 - F.size(F.array_distinct(words)) / count
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return {
        "symbols": F.least(F.sqrt(share(r"[^\p{L}\p{N}\s.,;:?'\x22()-]")), F.lit(0.5)) * 4,
        "upper": F.least(share(r"\p{Lu}"), F.lit(0.3)) * 6,
        "digits": F.least(share(r"\p{Nd}"), F.lit(0.3)) * 6,
        "repeats": repeats,
        # long texts repeat words anyway: what is beyond the usual for the length
        "repeats_by_length": repeats * F.log1p(count) / 8,
        "length": F.log1p(count) / 8,
        "word_length": F.least(n / count, F.lit(40.0)) / 10,
    }


def word_shares(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Scaled square roots of the shares of hashed words, then of hashed pairs of words, of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    out = np.zeros(2 * buckets)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pairs ^= pairs >> np.uint64(29)
    for k, held in enumerate((hashes, pairs)):
        if len(held):
            out[k * buckets : (k + 1) * buckets] = np.bincount((held % np.uint64(buckets)).astype(np.int64), minlength=buckets) / len(held)
    return SCALE * np.sqrt(out)


def words_logit(weights: tuple[float, ...]) -> Callable[[Column], Column]:
    """What a text's words add to its logit."""
    held = np.array(weights)

    @F.pandas_udf("double")
    def added(texts: pd.Series) -> pd.Series:
        return pd.Series([float(word_shares(t, len(held) // 2) @ held) for t in texts])

    return added


@dataclass(frozen=True)
class Model:
    """``weights``: bias, measures in the order of ``names``, hashed words and pairs (none: the text's words say nothing)."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    prior: float

    def logit(self, text: Column) -> Column:
        total = F.lit(self.weights[0])
        held = measures(text)
        for name, w in zip(self.names, self.weights[1:]):
            total = total + held[name] * w
        if words := self.weights[1 + len(self.names) :]:
            total = total + words_logit(words)(text)
        return F.least(F.greatest(total, F.lit(-MOST_LOGIT)), F.lit(MOST_LOGIT))


Sums = tuple[np.ndarray, np.ndarray]


def sums_of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
    """Gradient and Hessian (negated) of the rows' log likelihood at weights ``w`` (bias first)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def solved(sums: Callable[[np.ndarray], Sums], wide: int, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic regression with ``wide`` weights, given its sums at any weights."""
    w, penalty = np.zeros(wide), np.full(wide, ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        gradient, hessian = sums(w)
        step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def newton(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of rows that are at hand."""
    return solved(lambda w: sums_of(x, y, w), x.shape[1] + 1, ridge)


def sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, the same on every run."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The evidence model.  Its rows stay on the executors: each round adds up their sums there, at most ``PARTS`` of them.

    Of rows that repeat an id the least text counts, so the sample is the same whatever the order.
    """
    names = tuple(measures(F.col("text")))
    wide = 1 + len(names) + 2 * BUCKETS
    chosen = sample(labels.select("doc_id", "quality"), rows)  # bounded by ``rows``
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = held.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.min("text").alias("text"))
    shares = F.pandas_udf(lambda texts: pd.Series([word_shares(t).astype(np.float32).tobytes() for t in texts]), "binary")
    told = F.array(*measures(F.col("text")).values()).alias("told")
    made = one.select("doc_id", "quality", told, shares(F.col("text")).alias("shares"))
    made = cut(made.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id"))
    ends = made.agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.avg("quality").alias("mean")).first()
    if ends.low == ends.high:
        return Model(names, (MOST_LOGIT / 4, *[0.0] * len(names)), 0.5)

    def sums(w: np.ndarray) -> Sums:
        def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in source:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    left = np.array(part.column("told").to_pylist())
                    right = np.frombuffer(b"".join(part.column("shares").to_pylist()), np.float32).reshape(part.num_rows, -1)
                    g, h = sums_of(np.hstack([left, right]), part.column("quality").to_numpy(), w)
                    gradient, hessian = gradient + g, hessian + h
            yield pa.record_batch([pa.array([gradient.tobytes()]), pa.array([hessian.tobytes()])], names=["g", "h"])

        gradient, hessian = np.zeros(wide), np.zeros((wide, wide))
        for r in made.drop("doc_id").mapInArrow(added, "g binary, h binary").collect():  # ``PARTS`` rows of wide * wide numbers
            gradient += np.frombuffer(r.g)
            hessian += np.frombuffer(r.h).reshape(wide, wide)
        return gradient, hessian

    return Model(names, tuple(map(float, solved(sums, wide))), float(ends.mean))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, site: str, parent: str) -> float:
    """Prior strength (in documents) of ``parent`` for ``site``: within-site variance over between-site variance.

    ``sites``: n, total, squares per site with the parent's mean in ``parent``.
    """
    mean = F.col("total") / F.col("n")
    within = F.col("squares") - F.col("n") * mean * mean
    facts = sites.agg(
        F.sum(within).alias("within"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * (mean - F.col(parent)) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    n, k = facts["n"] or 0, facts["k"]
    if k < 2 or n <= k:
        return 100.0
    inside = max(facts["within"] / (n - k), 1e-9)
    spread = (facts["between"] - (k - 1) * inside) / max(n - facts["nn"] / n, 1e-9)
    return float(min(max(inside / spread, 1.0), 1e4)) if spread > 1e-9 else 1e4


def site_table(evidence: DataFrame) -> DataFrame:
    """host, path -> counts and sums of host and path, and the strengths of their priors.

    ``evidence``: host, path, p.
    """
    paths = cut(
        evidence.groupBy("host", "path").agg(
            F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")
        )
    )
    hosts = cut(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = (whole["total"] or 0.0) / max(whole["n"] or 0, 1)
    k_host = strength(hosts.withColumn("above", F.lit(mean)), "host", "above")
    h = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("total").alias("h_total"))
    h = small(h).withColumn("h_mean", (F.col("h_total") + k_host * mean) / (F.col("h_n") + k_host))
    joined = cut(paths.join(h, paths.host.eqNullSafe(F.col("h_host"))).drop("h_host"))
    k_path = strength(joined, "path", "h_mean")
    return cut(
        joined.select(
            F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "total", "h_n", "h_total",
            F.lit(mean).alias("mean"), F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path"),
        )
    )


def judged(evidence: DataFrame, sites: DataFrame, weight: float = SITE_WEIGHT, threshold: float = THRESHOLD) -> DataFrame:
    """``evidence`` (host, path, logit, p and other columns) with posteriors and ``keep``."""
    s = small(sites)
    joined = evidence.join(s, evidence.host.eqNullSafe(s.s_host) & evidence.path.eqNullSafe(s.s_path))
    p = F.col("p")
    host = (F.col("h_total") - p + F.col("k_host") * F.col("mean")) / (F.col("h_n") - 1 + F.col("k_host"))
    path = (F.col("total") - p + F.col("k_path") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k_path"))
    logit = F.col("logit") + weight * (_logit(F.col("path_posterior")) - _logit(F.col("mean")))
    return (
        joined.withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("posterior", 1 / (1 + F.exp(-logit)))
        .withColumn("keep", F.col("posterior") >= threshold)
        .drop("s_host", "s_path", "n", "total", "h_n", "h_total", "mean", "k_host", "k_path")
    )


def evidence_of(docs: DataFrame, model: Model, *columns: Column | str) -> DataFrame:
    logit = model.logit(F.col("text"))
    held = docs.select(*columns, F.col("source").alias("host"), F.col("lang").alias("path"), logit.alias("logit"))
    return held.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, host, path, evidence, posteriors and keep for every document."""
    evidence = cut(evidence_of(docs, fit(docs, labels, rows), "doc_id"))
    return judged(evidence, site_table(evidence)).select(
        "doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "posterior", "keep"
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns.  No text is shuffled: scores are worked out again."""
    model = fit(docs, labels, rows)
    sites = site_table(evidence_of(docs, model))
    held = docs.select(F.struct(*docs.columns).alias("row"), "source", "lang", "text")
    return judged(evidence_of(held, model, "row"), sites).filter("keep").select("row.*")
