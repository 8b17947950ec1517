"""What each filter of a chain removes, in every order in which the chain can run.

A document is known by the set of filters it fails. The sets of filters applied so far form a
lattice; applying one more filter is an edge, and an order is a path from the empty to the full
set. One pass over the lattice forwards counts the orders that reach a state, one backwards those
that leave it. An edge removes the documents that fail its filter and none applied before, so

* the step of an order is read off its edge: removed, kept, redundant;
* the sum of a filter's removals over all orders (its Shapley value times the number of orders) is
  the sum of its edges, each weighted by the orders that reach its start times those that leave its end.

Documents are summed to one row per part and set of failed filters before any of this, so only
that count sees the corpus; what follows has a fixed size per part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table

FILTERS = "ABCDE"
SPREAD = 1024  # parts of the join key that null ids are dealt to


@dataclass(frozen=True)
class Edge:
    """Filter number ``applied`` applied to the state ``start``, a bit set of filters."""

    start: int
    applied: int
    orders: int  # paths through this edge


@dataclass(frozen=True)
class Lattice:
    """States, edges and orders of ``size`` filters."""

    size: int
    edges: tuple[Edge, ...]
    #: Orders reaching a state, and orders leaving it.
    reaching: tuple[int, ...]
    leaving: tuple[int, ...]

    def paths(self) -> list[tuple[tuple[int, ...], list[int]]]:
        """Every order with the edges it takes."""
        index = {(e.start, e.applied): k for k, e in enumerate(self.edges)}
        found = []
        for order in permutations(range(self.size)):
            state, taken = 0, []
            for f in order:
                taken.append(index[state, f])
                state |= 1 << f
            found.append((order, taken))
        return found


def lattice(size: int) -> Lattice:
    """Count paths forwards from the empty state and backwards from the full one."""
    states = sorted(range(1 << size), key=lambda s: (s.bit_count(), s))
    reaching, leaving = [0] * (1 << size), [0] * (1 << size)
    reaching[0] = leaving[-1] = 1
    for s in states:
        for f in range(size):
            if not s >> f & 1:
                reaching[s | 1 << f] += reaching[s]
    for s in reversed(states):
        for f in range(size):
            if not s >> f & 1:
                leaving[s] += leaving[s | 1 << f]
    edges = tuple(
        Edge(s, f, reaching[s] * leaving[s | 1 << f]) for s in states for f in range(size) if not s >> f & 1
    )
    return Lattice(size, edges, tuple(reaching), tuple(leaving))


def _fixed(rows: list[dict], fields: str) -> Column:
    """A constant array of structs; one literal, however long."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","))


def audit(counts: DataFrame, names: Sequence[str], weights: Sequence[str] = ()) -> DataFrame:
    """Every step of every order for each part.

    ``counts`` has ``part``, ``failed`` (bit k set: fails ``names[k]``), ``n`` and a number for each
    name in ``weights``; several rows of one part and set add up. Returns part, filter_order (the
    names, joined), step (from 1), kept, removed, redundant, unique_fails, shapley, and for each
    weight its sum over the removed rows as ``lost_<weight>``. A part has a row for every order and
    step, zeros included. An empty table gives no rows. At most 8 filters: the result has n! rows.
    """
    if not 1 <= len(names) <= 8:
        raise ValueError("1 to 8 filters")
    grid = lattice(len(names))
    measures = ["n", *weights]
    sums = counts.groupBy("part", "failed").agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    # At most 2 ** len(names) entries for each part.
    parts = sums.groupBy("part").agg(F.collect_list(F.struct(F.col("failed").cast("int").alias("failed"), *measures)).alias("sets"))

    def total(measure: str, chosen) -> Column:
        return F.aggregate(
            "sets", F.lit(0).cast("long"), lambda a, s: a + F.when(chosen(s["failed"]), s[measure]).otherwise(F.lit(0).cast("long"))
        )

    edges = _fixed(
        [{"start": e.start, "bit": 1 << e.applied, "applied": e.applied, "orders": e.orders} for e in grid.edges],
        "start int, bit int, applied int, orders long",
    )

    def measured(e: Column) -> Column:
        start, bit = e["start"], e["bit"]
        gone = lambda s: (s.bitwiseAND(bit) != 0) & (s.bitwiseAND(start) == 0)
        return F.struct(
            e["applied"].alias("applied"), e["orders"].alias("orders"),
            total("n", lambda s: s.bitwiseAND(start.bitwiseOR(bit)) == 0).alias("kept"),
            *[total(m, gone).alias(f"gone_{m}") for m in measures],
            total("n", lambda s: (s.bitwiseAND(bit) != 0) & (s.bitwiseAND(start) != 0)).alias("redundant"),
            total("n", lambda s: s == bit).alias("unique_fails"),
        )

    edged = parts.select("part", F.transform(edges, measured).alias("edges"))
    def share(applied: int) -> Column:
        mine = F.filter("edges", lambda e: e["applied"] == applied)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, e: a + e["orders"] * e["gone_n"])

    weighed = edged.select("part", "edges", F.array(*[share(k) for k in range(grid.size)]).alias("shares"))
    steps = _fixed(
        [
            {"filter_order": "".join(names[f] for f in order), "step": k + 1, "edge": edge}
            for order, taken in grid.paths() for k, edge in enumerate(taken)
        ],
        "filter_order string, step int, edge int",
    )
    walked = weighed.select("part", "edges", "shares", F.explode(steps).alias("s"))
    found = walked.select("part", "s.filter_order", "s.step", F.get("edges", F.col("s.edge")).alias("e"), "shares")
    return found.select(
        "part", "filter_order", "step", F.col("e.kept").alias("kept"), F.col("e.gone_n").alias("removed"), F.col("e.redundant").alias("redundant"),
        F.col("e.unique_fails").alias("unique_fails"), *[F.col(f"e.gone_{w}").alias(f"lost_{w}") for w in weights],
        F.get("shares", F.col("e.applied")).alias("shapley"),
    )


_UPPER = bytes(range(65, 91))
_ODD = re.compile(r"[#$%&*|]")


def failed_by_text(text: str | None) -> int:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space: 0x20 and 0x09 to 0x0D
    n, distinct = len(words), len(set(words))
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        (n < 200)
        | (100 * distinct < 50 * n) << 1
        | (100 * upper > 2 * len(text)) << 2
        | (_ODD.search(text) is not None) << 3
    )


def _failed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([failed_by_text(x) for x in batch], dtype="int32")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, failed filters A to E, and labels: part, failed, n, good, toxic.

    E, a text that a smaller doc_id has too, is found without bringing the copies of a text
    together: every document is first counted as failing it, then those of the least id of each
    text, which a combining aggregate finds, are moved. A doc_id that comes several times with
    one text holds its sources in one row. A null doc_id is neither smaller nor larger than
    another. A document is good or toxic if any of its labels says so.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.pandas_udf(_failed, "int")("text").alias("failed"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"),
    )
    once = read.groupBy("doc_id", "sha", "failed", "part").count()
    rows = once.groupBy("doc_id", "sha", "failed").agg(F.collect_list(F.struct("part", "count")).alias("entries"))
    marked = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic").where("label_id IS NOT NULL").groupBy("label_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # Null ids find no label; spread, they don't meet in one task.
    dealt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    keyed = rows.withColumn("dealt", dealt)
    known = marked.withColumn("label_dealt", F.lit(0).cast("long"))
    joined = keyed.join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("dealt") == F.col("label_dealt")), "left").select(
        "doc_id", "sha", "failed", "entries", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    staged = stage(joined, "audited")
    copy = 1 << 4

    def counted(rows: DataFrame, sets: list[tuple[Column, int]]) -> DataFrame:
        spread = rows.withColumn("set", F.explode(F.array(*[F.struct(s.alias("failed"), F.lit(sign).alias("sign")) for s, sign in sets])))
        spread = spread.select("set.*", "good", "toxic", F.explode("entries").alias("e"))
        n = F.col("e.count") * F.col("sign")
        return spread.groupBy(F.col("e.part").alias("part"), "failed").agg(
            F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
        )

    own = F.col("failed")
    every = counted(staged, [(F.when(F.col("doc_id").isNull(), own).otherwise(own.bitwiseOR(F.lit(copy))), 1)])
    least = staged.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min(F.struct("doc_id", "failed", "good", "toxic", "entries")).alias("m")).select("m.*")
    moved = counted(least, [(own, 1), (own.bitwiseOR(F.lit(copy)), -1)])
    sums = every.unionByName(moved).groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    done = stage(sums, "failures")
    drop_staged(staged)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = audit(failures(docs, labels), FILTERS, ("good", "toxic"))
    return found.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), first AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
           CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
           CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 2 * length(words.t) THEN 'C' ELSE '' END,
           CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END,
           CASE WHEN words.doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM words JOIN first ON words.t = first.t LEFT JOIN marks ON words.doc_id = marks.doc_id
), sets AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT concat(a.c, b.c, d.c, e.c, f.c) AS filter_order
  FROM letters a JOIN letters b ON a.c <> b.c JOIN letters d ON d.c NOT IN (a.c, b.c)
  JOIN letters e ON e.c NOT IN (a.c, b.c, d.c) JOIN letters f ON f.c NOT IN (a.c, b.c, d.c, e.c)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k
), judged AS (
  SELECT part, filter_order, step, own, failed, n, good, toxic, contains(failed, own) AS fails,
    failed <> '' AND before <> '' AND regexp_matches(failed, concat('[', CASE WHEN before = '' THEN '-' ELSE before END, ']')) AS gone
  FROM steps, sets
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
), shares AS (SELECT part, own, sum(removed) AS shapley FROM counted GROUP BY part, own)
SELECT c.part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM counted c JOIN shares s ON c.part = s.part AND c.own = s.own
"""
