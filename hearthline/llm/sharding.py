"""Reproducible shuffle into equal shards by a Feistel permutation of row numbers.

Rows get global numbers 0..N-1, a keyed permutation of that range places each of them, and
shard and slot follow by division: ``position = permute(number)``, ``shard = position mod
shards``, ``slot = position div shards``. No row is compared with another, shard sizes
differ by one at most, and :func:`number_at` turns a (shard, slot) back into the row number.

Numbering: rows hash into ``buckets`` groups by id and text hash and are counted; a row's
number is the count of all earlier buckets plus its rank in its own one. Only ids, sizes and
hashes are shuffled, never texts, and the counts are the only broadcast: ``buckets`` rows at
most, whatever the input.

Permutation: a Feistel network on ``a x b`` cells, ``a = ceil(sqrt N)``, ``b = ceil(N / a)``,
so fewer than ``a`` cells lie beyond N. Those few are walked: the permutation is applied
again until the cell is below N. The number of applications that suffices is found by
walking the surplus cells alone (fewer than sqrt N), so no row is ever cut off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import table

ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1."""

    n: int
    seed: int = 2024
    walks: int = 1  # applications after which every row is inside

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.n, 1) - 1) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    def _once(self, x: Column, inverse: bool = False) -> Column:
        """One pass of the network: left and right halves take turns to be shifted."""
        keys = [self.seed * ROUNDS + r for r in range(ROUNDS)]
        turns = F.array(*[F.struct(F.lit(r % 2 == 0).alias("left"), F.lit(k).cast("long").alias("key"))
                          for r, k in (list(enumerate(keys))[::-1] if inverse else enumerate(keys))])
        start = F.struct(F.floor(x / F.lit(self.b)).cast("long").alias("l"), (x % F.lit(self.b)).cast("long").alias("r"))
        sign = F.lit(-1 if inverse else 1)

        def turn(s: Column, t: Column) -> Column:
            by_right = F.pmod(s.l + sign * F.pmod(F.xxhash64(t.key, s.r), F.lit(self.a)), F.lit(self.a))
            by_left = F.pmod(s.r + sign * F.pmod(F.xxhash64(t.key, s.l), F.lit(self.b)), F.lit(self.b))
            return F.struct(F.when(t.left, by_right).otherwise(s.l).cast("long").alias("l"),
                            F.when(t.left, s.r).otherwise(by_left).cast("long").alias("r"))

        return F.aggregate(turns, start, turn, lambda s: s.l * F.lit(self.b) + s.r)

    def _walk(self, x: Column, inverse: bool) -> Column:
        first = self._once(x.cast("long"), inverse)
        if self.walks == 1:
            return first
        again = F.sequence(F.lit(2), F.lit(self.walks))
        return F.aggregate(again, first, lambda p, _: F.when(p < self.n, p).otherwise(self._once(p, inverse)))

    def position(self, number: Column) -> Column:
        return self._walk(number, False)

    def number(self, position: Column) -> Column:
        return self._walk(position, True)


def permutation(spark: SparkSession, n: int, seed: int = 2024) -> Permutation:
    """The permutation of ``n`` rows, with the number of walks that all of them need.

    Only surplus cells that some row steps on matter: those whose predecessor is below n.
    Their paths lead back below n, so raising the limit ends; the rest form closed cycles.
    """
    once = Permutation(n, seed)
    entered = spark.range(n, once.a * once.b).where(once._once(F.col("id"), inverse=True) < n)
    limit = 1
    while True:
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(limit)), F.col("id"), lambda p, _: F.when(p < n, p).otherwise(once._once(p))
        )
        if not entered.where(walked >= n).limit(1).count():
            return Permutation(n, seed, limit + 1)
        limit *= 2


def shard_documents(
    docs: DataFrame, shards: int = 16, seed: int = 2024, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1, with null checksum); law ``rows``:
    shard counts differ by one at most. Repeated rows count one by one, null ids are placed
    like any other, an empty table gives no rows. Columns of ``docs`` beyond id and text are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    ).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(buckets)).cast("int"))
    placed, _ = _place(spark, rows, shards, seed, ["doc_id", "_hash"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _place(spark: SparkSession, rows: DataFrame, shards: int, seed: int, order: list[str]) -> tuple[DataFrame, Permutation]:
    from pyspark.sql import Window as W

    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` rows: the one window without partitions and the broadcast are bounded.
    offsets = counts.select(
        "_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    perm = permutation(spark, rows.count(), seed)
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    numbered = rows.join(F.broadcast(offsets), "_bucket").withColumn("row_number", F.col("_before") + rank - 1)
    position = numbered.withColumn("position", perm.position(F.col("row_number")))
    return position.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / shards).cast("long")
    ), perm


def number_at(perm: Permutation, shards: int, shard: Column, slot: Column) -> Column:
    """The row number that a (shard, slot) holds."""
    return perm.number(slot * shards + shard)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
