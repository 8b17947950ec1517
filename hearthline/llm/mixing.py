"""Mixing to target weights with soft domain membership.

1. A softmax classifier learns domains from a labelled table: features are hashed byte pairs of
   the text, rows at most ``train_rows`` of least hashed id.
2. Every document gets its posterior over domains, in steps of 1/``grid``, and its token count.
   Documents of equal posterior behave alike, so they are summed into cells.
3. Projected-gradient least squares finds a nonnegative rate for each cell: the expected tokens
   of a domain, sum of rate x tokens x posterior, shall be its target. Rates start at 1, and the
   gradient is taken in the token-weighted inner product, where its steps don't depend on the
   number of documents, and preconditioned by the inverse of the domain-by-domain metric, so that
   small domains close their gaps as fast as large ones. A step reads the domain totals of the
   cells, an aggregation in Spark. Each domain is held against its own target; a miss that stays
   is kept in ``Rates.missed`` and logged as a warning.
4. A rate is a number of copies: its whole part always, one more by a hash of the row.

A rate follows from the posterior and the residuals of all steps, so it is computed where the
document is: no join, no shuffle of texts.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import stage, table

PAIRS = 512  # hashed byte pairs
LOG = logging.getLogger(__name__)


def pair_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs in the lower-cased text."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 2:
        return np.zeros(PAIRS)
    hashed = ((data[:-1] * np.uint32(31) + data[1:]) * np.uint32(2654435761)) >> np.uint32(23)
    counts = np.bincount(hashed, minlength=PAIRS)
    return np.sqrt(counts / counts.sum())


@dataclass(frozen=True)
class Domains:
    """A fitted softmax over domains."""

    names: tuple[str, ...]
    weights: np.ndarray  # domains x PAIRS
    intercepts: np.ndarray
    grid: int

    def posteriors(self, texts: pd.Series) -> np.ndarray:
        """Posterior of each text in whole steps; the steps of a text sum to ``grid``."""
        x = np.stack([pair_shares(t) for t in texts]) if len(texts) else np.zeros((0, PAIRS))
        z = x @ self.weights.T + self.intercepts
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) * self.grid
        steps = np.floor(p).astype(np.int64)
        rest = self.grid - steps.sum(axis=1)
        order = np.argsort(-(p - steps), axis=1, kind="stable")
        for row in np.flatnonzero(rest):
            steps[row, order[row, :rest[row]]] += 1
        return steps


def fit_domains(docs: DataFrame, labelled: DataFrame, train_rows: int = 4000, grid: int = 50, seed: int = 3) -> Domains:
    """Learn from ``labelled`` (doc_id, domain): rows with both, at most ``train_rows`` of least hashed id.

    Without labelled documents there is one domain, ``all``.
    """
    usable = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna().distinct()
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "domain").limit(train_rows)

    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([pair_shares(t) for t in batch])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most train_rows narrow rows: a proven bound for the broadcast.
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "domain", F.pandas_udf(shares, "array<double>")("text").alias("x"))
    rows = rows.dropDuplicates(["doc_id", "domain"]).repartition(1).sortWithinPartitions("doc_id", "domain").persist()
    try:
        names = tuple(r[0] for r in rows.select("domain").distinct().orderBy("domain").collect())
        if len(names) < 2:
            return Domains(names or ("all",), np.zeros((1, PAIRS)), np.zeros(1), grid)
        place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("domain")) - 1
        data = rows.select(place.cast("double").alias("label"), array_to_vector("x").alias("x"))
        model = LogisticRegression(labelCol="label", featuresCol="x", family="multinomial", regParam=1e-4, maxIter=40, standardization=False).fit(data)
        return Domains(names, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), grid)
    finally:
        rows.unpersist()


def members(docs: DataFrame, domains: Domains) -> DataFrame:
    """``docs`` with ``_tokens`` (words, at least 1) and ``_posterior`` (steps of 1/grid)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [max(1, len((t or "").split())) for t in batch]
            yield pd.DataFrame({"tokens": tokens, "posterior": list(domains.posteriors(batch))})

    found = F.pandas_udf(run, "tokens long, posterior array<long>")("text")
    return docs.withColumn("_m", found).withColumns({"_tokens": F.col("_m.tokens"), "_posterior": F.col("_m.posterior")}).drop("_m")


def smoothed_targets(totals: np.ndarray, power: float = 0.7, margin: float = 1.01) -> np.ndarray:
    """Token targets proportional to totals ** power, ``margin`` above what makes no domain shrink."""
    held = np.where(totals > 0, totals, 0.0)
    wanted = np.where(held > 0, held ** power, 0.0)
    ratio = np.divide(wanted, held, out=np.full(len(held), np.inf), where=held > 0)
    return margin * wanted / ratio.min() if np.isfinite(ratio.min()) else held


def given_targets(totals: np.ndarray, names: tuple[str, ...], weights: dict[str, float], tokens: float | None = None) -> np.ndarray:
    """Token targets in the proportions of ``weights``: ``tokens`` in all, else as many as there are."""
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in names])
    return share / max(share.sum(), 1e-300) * (totals.sum() if tokens is None else tokens)


@dataclass(frozen=True)
class Rates:
    """Residuals of all steps; the rate of a posterior is their projected sum."""

    steps: np.ndarray  # steps x domains, the change per unit of posterior
    grid: int
    least: float = 0.0
    missed: tuple[float, ...] = ()  # of each domain, the miss relative to its target that is left

    def of(self, posterior: Column) -> Column:
        """The rate of a posterior column, folding the steps in the JVM."""
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.steps])
        part = F.transform(posterior, lambda p: p / F.lit(float(self.grid)))

        def fold(rate: Column, step: Column) -> Column:
            change = F.aggregate(F.zip_with(part, step, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
            return F.greatest(F.lit(self.least), rate - change)

        return F.aggregate(steps, F.lit(1.0), fold) if len(self.steps) else F.lit(1.0)


def _inverse(metric: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of the metric, scaled so that small domains aren't taken for noise."""
    own = np.sqrt(np.diag(metric))
    scale = np.divide(1.0, own, out=np.zeros_like(own), where=own > 0)
    return scale[:, None] * np.linalg.pinv(metric * scale[:, None] * scale, rcond=1e-9, hermitian=True) * scale


def fit_rates(cells: DataFrame, n_domains: int, grid: int, targets, max_steps: int = 60, tolerance: float = 1e-3, least: float = 0.0) -> Rates:
    """Rates of ``least`` or more for staged cells (posterior, tokens); ``targets`` maps domain totals to token targets.

    Stops when every domain is within ``tolerance`` of its target, relative to that target (to
    all tokens if it is zero), or when a step no longer helps: targets that no such rates reach
    are met as nearly as least squares in the inverse metric can, and the misses are logged.
    """
    p = [F.get("posterior", F.lit(k)) / F.lit(float(grid)) for k in range(n_domains)]

    def totals(rates: Rates) -> np.ndarray:
        own = rates.of(F.col("posterior"))
        row = cells.select(*[(own * F.col("tokens") * x).alias(f"d{k}") for k, x in enumerate(p)]).agg(*[F.sum(f"d{k}") for k in range(n_domains)]).first()
        return np.array([x or 0.0 for x in row], dtype=float)

    rates = Rates(np.zeros((0, n_domains)), grid, least)
    now = totals(rates)
    whole = max(now.sum(), 1.0)
    target = targets(now) / whole
    pairs = [(a, b) for a in range(n_domains) for b in range(a, n_domains)]
    row = cells.agg(*[F.sum(F.col("tokens") * p[a] * p[b]).alias(f"m{k}") for k, (a, b) in enumerate(pairs)]).first()
    metric = np.zeros((n_domains, n_domains))
    for (a, b), value in zip(pairs, row):
        metric[a, b] = metric[b, a] = (value or 0.0) / whole
    inverse = _inverse(metric)
    scale = np.where(target > 0, target, 1.0)
    done, before = [], np.inf
    while True:
        residual = now / whole - target
        missed = np.abs(residual) / scale
        away = float(residual @ inverse @ residual)  # what a step of size 1 never raises
        if missed.max(initial=0.0) <= tolerance or away > before * 0.9999 or len(done) == max_steps:
            break
        before = away
        done.append(inverse @ residual)
        rates = Rates(np.array(done), grid, least)
        now = totals(rates)
    if missed.max(initial=0.0) > tolerance:
        LOG.warning("domain targets are missed by %s after %d steps", np.round(missed, 4).tolist(), len(done))
    return Rates(rates.steps, grid, least, tuple(missed.tolist()))


def fit_mixing(docs: DataFrame, labelled: DataFrame, targets=smoothed_targets, **options) -> tuple[Domains, Rates]:
    domains = fit_domains(docs, labelled, **options)
    cells = members(docs.select("text"), domains).groupBy(F.col("_posterior").alias("posterior")).agg(F.sum("_tokens").alias("tokens"))
    least = 1.0 if targets is smoothed_targets else 0.0  # these lose no document, whatever the posteriors
    return domains, fit_rates(stage(cells, "cells"), len(domains.names), domains.grid, targets, least=least)


def copies(rate: Column, key: list[str], seed: int = 17) -> Column:
    """Whole copies of a row: the rate's floor, and one more with the chance of its fraction."""
    chance = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def rated(docs: DataFrame, domains: Domains, rates: Rates) -> DataFrame:
    """``docs`` with _tokens, _posterior, _rate and _copies."""
    found = members(docs, domains).withColumn("_rate", F.round(rates.of(F.col("_posterior")), 9))
    return found.withColumn("_copies", copies(F.col("_rate"), ["doc_id", "text"]))


def mix(docs: DataFrame, labelled: DataFrame, targets=smoothed_targets, **options) -> DataFrame:
    """``docs`` with every row as often as its copies say, in its own columns.

    By default targets smooth the domains' shares upwards and rates are held at 1 or more, so no
    document is lost; other targets may give rates below 1. Null and empty texts count one token
    and have the posterior of the intercepts. An empty table stays empty.
    """
    domains, rates = fit_mixing(docs, labelled, targets, **options)
    # the row travels as one column, so that its own names can't clash with those of ``rated``
    found = rated(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), domains, rates).where(F.col("_copies") > 0)
    return found.select("row", F.explode(F.sequence(F.lit(1), "_copies"))).select("row.*")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: the language of documents that ``labels`` covers."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(known, "doc_id", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    domains, rates = fit_mixing(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))
    found = rated(docs.select("doc_id", "text"), domains, rates)
    shares = F.transform("_posterior", lambda p: p / F.lit(float(domains.grid)))
    return found.select(
        "doc_id", F.col("_tokens").alias("n_tokens"), F.lit(",".join(domains.names)).alias("domains"), shares.alias("posterior"),
        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
    )
