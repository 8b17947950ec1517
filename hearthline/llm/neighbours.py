"""Approximate nearest neighbours by shifted space-filling curves.

Each ordering projects the vectors on a few random directions, shifts the grid by a random
amount and numbers its cells along a Hilbert curve. The curve is cut into ``parts`` ranges of
keys; a query meets the vectors of its own range and of the two beside it, in every ordering,
and the best of all meetings are merged and ranked by their exact inner products.

Directions, shifts and the cuts of the curve come from a seed and a bounded sample
(``fit_rows`` vectors of least hashed id); every vector is indexed. A range is a fixed share of
the curve, so recall doesn't fall as tables grow. A range that holds more than ``piece_rows``
vectors (many equal keys, say) is split into pieces by hash, and its queries visit each piece:
tasks hold a bounded number of vectors and stream the queries past them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import stage, table


LEAST_ROWS = 64  # of the sample in a range; small tables have fewer ranges


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (n x dims, ``bits`` bits each) along the Hilbert curve.

    The usual passage through Gray code: undo the rotations of the sub-cubes from the coarsest
    bit down, Gray-decode across dimensions, and interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            flip = ((axis >> bit) & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turned = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= turned
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            keys = (keys << 1) | ((axis >> bit) & 1)
    return keys


@dataclass(frozen=True)
class Curves:
    """The fitted orderings."""

    directions: np.ndarray  # orderings x dims x vector length
    levels: np.ndarray  # orderings x dims x quantiles of the projections
    shifts: np.ndarray  # orderings x dims, in 0..1
    cuts: tuple[np.ndarray, ...]  # of each ordering: the different keys at which a range begins
    bits: int

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        projected = vectors @ self.directions[ordering].T
        levels = self.levels[ordering]
        side = 1 << self.bits
        cells = np.empty(projected.shape, np.int64)
        for k in range(projected.shape[1]):
            at = np.interp(projected[:, k], levels[k], np.linspace(0, 1, levels.shape[1]))
            cells[:, k] = np.minimum((at + self.shifts[ordering, k]) * 0.5 * side, side - 1)
        return hilbert_keys(cells, self.bits)

    def parts_of(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        return np.searchsorted(self.cuts[ordering], self.keys(vectors, ordering), side="right")


def fit_curves(sample: np.ndarray, orderings: int, dims: int, bits: int, parts: int, seed: int) -> Curves:
    rng = np.random.default_rng(seed)
    length = sample.shape[1]
    dims = min(dims, length)
    directions = np.stack([np.linalg.qr(rng.normal(size=(length, length)))[0][:, :dims].T for _ in range(orderings)])
    shifts = rng.random((orderings, dims))
    levels = np.stack([np.quantile(sample @ d.T, np.linspace(0, 1, 257), axis=0).T for d in directions])
    bare = Curves(directions, levels, shifts, (), bits)
    parts = min(parts, max(1, len(sample) // LEAST_ROWS))
    keys = [np.sort(bare.keys(sample, k)) for k in range(orderings)]
    at = (np.arange(1, parts) * len(sample)) // parts
    return Curves(directions, levels, shifts, tuple(np.unique(x[at]) for x in keys), bits)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores to 40 bits, relative to each score's own size."""
    bits = np.ascontiguousarray(scores, np.float64).view(np.int64)
    return ((bits + (1 << 11)) & ~np.int64((1 << 12) - 1)).view(np.float64)


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row; among equals (to 1e-12 of their size) the first columns."""
    scores = _rounded(scores)
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    for row in np.flatnonzero((scores >= least).sum(axis=1) > k):
        found[row] = np.argsort(-scores[row], kind="stable")[:k]
    return found


VISIT = "ordering int, part int, piece int, is_query boolean, vec_id long, embedding array<float>"
FOUND = "query_id long, ids array<long>, scores array<double>"


def search(
    vectors: DataFrame, queries: Column, k: int = 20, orderings: int = 12, dims: int = 6, bits: int = 10, parts: int = 16,
    fit_rows: int = 4096, piece_rows: int = 2048, seed: int = 11,
) -> DataFrame:
    """The ``k`` best found for each row of ``vectors`` where ``queries`` holds: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null, zero
    or hold null or non-finite components, rows without id, and vectors of another length than
    most take no part. A query never finds rows of its own id; repeated ids are found once, with their best
    score. Ties go to the smaller id. Fewer candidates than ``k`` are all returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == lengths[0].n)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(fit_rows).select("embedding").toArrow()
    curves = spark.sparkContext.broadcast(  # a few matrices, whatever the input
        fit_curves(_matrix(sample["embedding"].combine_chunks()), orderings, dims, bits, parts, seed)
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["embedding"])
                at = np.stack([curves.value.parts_of(x, o) for o in range(orderings)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["embedding"], batch["is_query"], pa.FixedSizeListArray.from_arrays(at.ravel(), orderings).cast(pa.list_(pa.int32()))],
                    ["vec_id", "embedding", "is_query", "at"],
                )

    placed = stage(
        rows.withColumn("is_query", F.coalesce(queries, F.lit(False)))
        .mapInArrow(place, "vec_id long, embedding array<float>, is_query boolean, at array<int>"), "placed-vectors",
    )
    # At most orderings x parts counts.
    counts = placed.select(F.posexplode("at").alias("o", "p")).groupBy("o", "p").count().collect()
    pieces = np.ones((orderings, parts), np.int64)
    for r in counts:
        pieces[r.o, r.p] = -(-r["count"] // piece_rows)
    split = F.array(*[F.array(*[F.lit(int(n)) for n in row]) for row in pieces])

    own = placed.select("vec_id", "embedding", F.posexplode("at").alias("ordering", "part"))
    held = own.select(
        "ordering", "part", F.pmod(F.xxhash64("vec_id"), split[F.col("ordering")][F.col("part")]).cast("int").alias("piece"),
        F.lit(False).alias("is_query"), "vec_id", "embedding",
    )
    asked = placed.where("is_query").select("vec_id", "embedding", F.posexplode("at").alias("ordering", "own"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.greatest(F.col("own") - 1, F.lit(0)), F.least(F.col("own") + 1, F.lit(parts - 1)))))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), (split[F.col("ordering")][F.col("part")] - 1).cast("int"))))
    visits = held.unionByName(asked.select("ordering", "part", "piece", F.lit(True).alias("is_query"), "vec_id", "embedding"))
    group = ["ordering", "part", "piece"]
    # Vectors before queries: a task holds one piece and streams its queries.
    dealt = visits.repartition(*group).sortWithinPartitions(*group, "is_query", "vec_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held_rows = None, [], []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in group])
            asks = batch["is_query"].to_numpy(zero_copy_only=False)
            names, x = batch["vec_id"].to_numpy(), _matrix(batch["embedding"])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                key = tuple(keys[:, a])
                if key != now:
                    now, ids, held_rows = key, [], []
                middle = a + int(np.count_nonzero(~asks[a:b]))
                if middle > a:
                    ids.append(names[a:middle])
                    held_rows.append(x[a:middle])
                if middle < b and ids:
                    ids, held_rows = [np.concatenate(ids)], [np.concatenate(held_rows)]
                    for c in range(middle, b, 256):
                        yield _best(names[c:min(c + 256, b)], x[c:min(c + 256, b)], ids[0], held_rows[0], k)

    met = dealt.mapInArrow(meet, FOUND)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, [], []
        for batch in batches:
            for query_id, a, b in zip(batch[0].to_pylist(), batch[1], batch[2]):
                if query_id != now:
                    if now is not None:
                        yield _ranked(now, ids, scores, k)
                    now, ids, scores = query_id, [], []
                ids.append(a.values.to_numpy())
                scores.append(b.values.to_numpy())
        if now is not None:
            yield _ranked(now, ids, scores, k)

    return met.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, schema)


def _best(asking: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    scores = q @ x.T
    scores[asking[:, None] == ids[None, :]] = -np.inf
    # As many rows as surely hold k different ids.
    top = best_of(scores, k * int(np.unique(ids, return_counts=True)[1].max()))
    exact = np.einsum("qd,qkd->qk", q, x[top])
    valid = np.take_along_axis(scores, top, axis=1) > -np.inf
    return pa.RecordBatch.from_arrays(
        [pa.array(asking), pa.array([ids[t][v] for t, v in zip(top, valid)], pa.list_(pa.int64())),
         pa.array([e[v] for e, v in zip(exact, valid)], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])


def _ranked(query_id: int, ids: list[np.ndarray], scores: list[np.ndarray], k: int) -> pa.RecordBatch:
    name, score = np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((-score, name))
    name, score = name[order], score[order]
    first = np.concatenate(([True], name[1:] != name[:-1]))[:len(name)]
    name, score = name[first], score[first]
    order = np.lexsort((name, -score))[:k]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(order), query_id)), pa.array(np.arange(1, len(order) + 1, dtype=np.int32)), pa.array(name[order]), pa.array(score[order])],
        ["query_id", "rank", "vec_id", "score"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
