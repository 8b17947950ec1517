"""Document quality by a sparse rule ensemble.

1. Statistics of the whole text (shares of capitals, digits, symbols; repetition; lengths).
2. A small forest over those statistics; every path from a root is a conjunctive rule.
3. Lasso logistic weights over the rules; most become zero.
4. The rules left are compiled into one column expression: a sum of ``CASE WHEN`` terms.

The model is fitted on at most ``train_rows`` labelled rows, those of least hashed id; every
document is scored. Labels, language, source and id are never inputs of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table, unused

STATISTICS = (
    "n_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "stop_share", "mark_share",
    "space_share", "unique_words", "repeated_words", "symbol_words", "line_words", "repeated_lines", "longest_word",
)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_STOP = np.isin(_BYTE, list(b".,"))
_MARK = np.isin(_BYTE, list(b"!?;:'\"()-"))
_HIGH = _BYTE >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP | _MARK | _HIGH)
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _MARK, _SPACE, _UPPER | _LOWER | _HIGH]).astype(np.float64)
_LETTERS = bytes(np.flatnonzero(_UPPER | _LOWER | _DIGIT | _HIGH).astype(np.uint8))


def describe(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; all zero if it has no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digit, symbol, stop, mark, space, letter = (_CLASSES @ counts).tolist()
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x]
    return (
        float(n), sum(map(len, words)) / n, upper / max(letter, 1), digit / size, symbol / size, stop / size,
        mark / size, space / size, sum(len(set(words[k:k + BLOCK])) for k in range(0, n, BLOCK)) / n, sum(map(eq, words, words[1:])) / n,
        sum(1 for x in set(words) if not x[-1:] in _WORD_END) / len(set(words)),
        n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), float(max(map(len, words))),
    )


#: Words are counted as distinct within blocks of so many, so that long texts aren't held against themselves.
BLOCK = 64
_WORD_END = {bytes([x]) for x in _LETTERS} | {b".", b","}


def _describe_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([describe(x) for x in batch], columns=list(STATISTICS), dtype="float64")


def statistics(text: str) -> Column:
    """All statistics of a text column as a struct."""
    kind = ", ".join(f"{x} double" for x in STATISTICS)
    return F.pandas_udf(_describe_all, kind)(text)


Condition = tuple[str, bool, float]  # statistic, whether at most (else above), threshold


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights; ``score`` is the logistic of their sum."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: tuple[Condition, ...], stats: Column) -> Column:
    held = F.lit(True)
    for name, at_most, threshold in rule:
        value = stats[name]
        held = held & ((value <= threshold) if at_most else (value > threshold))
    return held


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def tree_rules(model) -> list[tuple[Condition, ...]]:
    """Every path from a root to a node below it, without repetition."""
    found: dict[tuple[Condition, ...], None] = {}

    def visit(node, path: tuple[Condition, ...]) -> None:
        if path:
            found.setdefault(tuple(sorted(set(path))), None)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
            visit(node.leftChild(), (*path, (name, True, threshold)))
            visit(node.rightChild(), (*path, (name, False, threshold)))

    for tree in model.trees:
        visit(tree._java_obj.rootNode(), ())
    return list(found)


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, trees: int = 16, depth: int = 3,
    penalty: float = 0.001, seed: int = 7,
) -> RuleModel:
    """Fit on at most ``train_rows`` rows of ``labels`` that aren't held out.

    Rows with null id or label are left out; a document with several labels counts once for
    each. Without rows of both labels, or when no statistic tells them apart, there are no rules
    and the score is the share of label 1
    (0.5 without any row).
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    usable = named.where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample is at most train_rows narrow rows: a proven bound for the broadcast.
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", statistics("text").alias("s"))
    # written once: the forest and the weights are fitted on these rows, the texts are read no more
    rows = stage(rows.select("doc_id", "label", "s.*").dropDuplicates(), "training-rows")
    order = ("doc_id", "label", *STATISTICS)
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows)
    data = data.repartition(1).sortWithinPartitions(*order).select("label", "x").persist()
    fired = None
    try:
        totals = {r[0]: r[1] for r in data.groupBy("label").count().collect()}
        rules: list[tuple[Condition, ...]] = []
        if len(totals) == 2:
            forest = RandomForestClassifier(
                labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=2,
                featureSubsetStrategy="onethird", seed=seed,
            ).fit(data)
            rules = tree_rules(forest)
        if not rules:
            p = min(max(totals.get(1.0, 0) / sum(totals.values()), 0.01), 0.99) if totals else 0.5
            return RuleModel(float(np.log(p / (1 - p))), ())
        held = [F.when(_holds(r, F.struct(*STATISTICS)), 1.0).otherwise(0.0) for r in rules]
        one = rows.repartition(1).sortWithinPartitions(*order)
        fired = one.select("label", array_to_vector(F.array(*held)).alias("x")).persist()
        lasso = LogisticRegression(
            labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
        ).fit(fired)
        weights = lasso.coefficients.toArray()
        kept = tuple((rules[k], float(weights[k])) for k in np.flatnonzero(np.abs(weights) > 1e-9))
        return RuleModel(float(lasso.intercept), kept)
    finally:
        data.unpersist()
        if fired is not None:
            fired.unpersist()
        drop_staged(rows)


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with its score in column ``score``; one Python pass over the texts.

    Null and empty texts have all statistics zero and get a score like any other; long texts
    are read whole. Repeated rows stay. A column ``score`` of ``docs`` is replaced.
    """
    stats = unused(docs, "stats")
    return docs.withColumn(stats, statistics("text")).withColumn("score", model.score(F.col(stats))).drop(stats)


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the columns of ``docs``."""
    stats = unused(docs, "stats")
    scored = docs.withColumn(stats, statistics("text"))
    return scored.where(model.score(F.col(stats)) >= least).drop(stats)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
