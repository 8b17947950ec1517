"""Near duplicates by SimHash and a Gray-order hierarchical index.

Fingerprint: 64 bits over the 4-word shingles of the whole text. Two fingerprints link when
they differ in at most 4 bits; documents in one connected component are near duplicates.

Index. The 64 bits are cut into six fields. Fingerprints at distance 4 or less agree in two
fields at least, so each of the 15 masks of two fields is an upper level: the fingerprints that
share a masked pattern form one group, and every pair in reach meets in some group. Within a
group fingerprints are sorted by Gray rank, which puts those with common bits side by side.
Runs of neighbours form nodes that hold the bits all members share (mask and pattern); nodes of
nodes hold fewer. A search starts at the top: differences on a node's mask accumulate downwards
(a child only adds its further bits), and a group whose sum exceeds 4 is dropped whole.

Scale. Copies collapse to one fingerprint before anything else. A group that outgrows
``group_rows`` is cut into pieces by hash, and each pair of pieces is a task of its own, so no
task holds an unbounded group and no pair is lost. A group gives the edges of a spanning forest,
never all its pairs: at most as many rows as members. Components come from ``graph``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import stage, table, unused
from hearthline.llm.graph import connected_components

REACH = 4
SHINGLE = 4
SEED = 42
FIELDS = (11, 11, 11, 11, 10, 10)
FAN = 16  # members of a node of the index


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    pieces = [line[a:b] for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(x) for x in batch], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.pandas_udf(_signed, "long")(text)


def masks() -> list[int]:
    """The masks of two fields, as unsigned numbers."""
    at, fields = 0, []
    for width in FIELDS:
        fields.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(fields, 2)]


def gray_rank(x: Column) -> Column:
    """Place of a code word in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


class GrayIndex:
    """The nodes over one group of fingerprints in Gray order."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # mask and pattern of each node, leaves' parents first
        ones, zeros = prints, ~prints
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones))

    def near(self, x: np.uint64, alive: np.ndarray) -> np.ndarray:
        """Places of living members at REACH or less from ``x``."""
        nodes = np.zeros(1, np.int64)
        spent = np.zeros(1, np.int64)
        known = np.zeros(1, np.uint64)  # bits that the nodes above have counted
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            if level < len(self.levels) - 1:
                nodes, spent, known = self._children(nodes, spent, known, len(mask))
            fresh = mask[nodes] & ~known
            spent = spent + np.bitwise_count((x ^ pattern[nodes]) & fresh)
            held = spent <= REACH
            nodes, spent, known = nodes[held], spent[held], mask[nodes[held]]
        if not self.levels:
            return np.zeros(1, np.int64) if alive[0] and np.bitwise_count(x ^ self.prints[0]) <= REACH else np.zeros(0, np.int64)
        members, spent, known = self._children(nodes, spent, known, len(self.prints))
        live = alive[members]
        members, spent, known = members[live], spent[live], known[live]
        return members[spent + np.bitwise_count((x ^ self.prints[members]) & ~known) <= REACH]

    @staticmethod
    def _children(nodes: np.ndarray, spent: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        held = below < n
        return below[held], np.repeat(spent, FAN)[held], np.repeat(known, FAN)[held]


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints in Gray order."""
    index, alive, found = GrayIndex(prints), np.ones(len(prints), bool), []
    for start in range(len(prints)):
        if not alive[start]:
            continue
        alive[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            near = index.near(prints[at], alive)
            if len(near):
                alive[near] = False
                queue += near.tolist()
                found += zip(repeat(at), near.tolist())
    return found


def _group_links(prints: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Spanning edges of all groups; ``groups`` numbers the rows' groups in ascending order."""
    cuts = np.flatnonzero(np.diff(groups)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(groups)]))
    sizes = ends - starts
    small = np.repeat(sizes <= FAN, sizes)
    links = []
    for step in range(1, int(min(sizes.max(initial=0), FAN))):
        near = small[step:] & (groups[step:] == groups[:-step]) & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= REACH)
        at = np.flatnonzero(near)
        links.append(np.stack([prints[at], prints[at + step]], axis=1))
    for k in np.flatnonzero(sizes > FAN):
        own = prints[starts[k]:ends[k]]
        pairs = np.array(forest(own), np.int64).reshape(-1, 2)
        links.append(own[pairs])
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, i, j, fp) in order of group and Gray rank to links (a, b)."""
    rest: pa.Table | None = None

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("mask", "pattern", "i", "j")])
        change = (np.diff(keys, axis=1) != 0).any(axis=0)
        groups = np.concatenate(([0], np.cumsum(change)))
        found = _group_links(rows["fp"].to_numpy().view(np.uint64), groups).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
        keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("mask", "pattern", "i", "j")])
        change = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0))
        if not len(change):
            rest = rows
            continue
        cut = int(change[-1]) + 1
        yield links(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield links(rest)


def links(prints: DataFrame, group_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs in reach would."""
    def literal(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")

    masked = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(literal(m)).alias("pattern")) for k, m in enumerate(masks())
    ])).alias("g")).select("fp", "g.*")
    hot = masked.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    cut = masked.join(hot, ["mask", "pattern"], "left")
    pieces = F.ceil(F.coalesce("n", F.lit(1)) / group_rows).cast("int")
    piece = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    spread = cut.withColumn("p", piece).withColumn("q", F.explode(F.sequence(F.lit(0), pieces - 1)))
    keyed = spread.select("mask", "pattern", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "fp")
    key = ["mask", "pattern", "i", "j"]
    ordered = keyed.repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("fp")))
    return ordered.mapInArrow(link_groups, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, group_rows: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp (signed), component_id.

    ``component_id`` is the least doc_id that can be reached, itself included. Null and empty
    texts have fingerprint zero and link like any other. Null ids belong to components but never
    name one unless it has no other id. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_of(F.col("text")).alias("fp")), "fingerprints")
    return _named(rows, links(rows.select("fp").distinct(), group_rows))


def _named(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, fp) with the least doc_id of each component of ``edges`` between values of fp."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(edges)
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "text_hash", "fp", "component_id")


def shingles_of(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; a shorter text is one shingle, no words give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    pieces = [line[a:b] for a, b in zip(starts, ends[min(width, len(words)) - 1:].tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n))


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def band_keys(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A MinHash key for each band; ``factors`` and ``offsets`` are bands x rows, factors odd."""
    least = np.full(factors.size, ~np.uint64(0))
    for k in range(0, len(shingles), 512):
        mixed = shingles[k:k + 512] * factors.reshape(-1, 1) + offsets.reshape(-1, 1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(factors.shape)], np.uint64).view(np.int64)


def similar_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs of sets with an exact Jaccard index of ``similarity`` or more."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marked = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    alive, found = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start] = False
        queue = [start]
        while queue and alive.any():
            at = queue.pop()
            own = codes[starts[at]:starts[at] + sizes[at]]
            marked[own] = True
            left = np.flatnonzero(alive & (np.minimum(sizes, sizes[at]) >= similarity * np.maximum(sizes, sizes[at]) - 1e-9))
            shared = np.array([np.count_nonzero(marked[codes[starts[k]:starts[k] + sizes[k]]]) for k in left], np.int64)
            marked[own] = False
            near = left[shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9]
            alive[near] = False
            queue += near.tolist()
            found += zip(repeat(at), near.tolist())
    return found


def similar_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 40, band_rows: int = 5, piece_rows: int = 256, seed: int = SEED,
) -> DataFrame:
    """As ``near_duplicates``, linked by the exact Jaccard index of their sets of ``shingle`` words; fp names the set.

    A fingerprint of 64 bits can't be searched at the reach that 0.8 takes (about 10 bits, up to
    twice that), so candidates meet in MinHash bands: of pairs at 0.8 these defaults leave out
    (1 - 0.8**5)**40, about one in eight million, and fewer above. Equal sets are one node. Nodes that
    bands connect form a pool; a pool that outgrows ``piece_rows`` is cut into pieces by hash, and
    each pair of pieces is a task of its own, in which all pairs are held against ``similarity``.
    Texts without words are alike.
    """
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, (bands, band_rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, (bands, band_rows), dtype=np.uint64)

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a set is dropped before the next text's: sets outweigh the texts they come from
            signs = [(set_name(s), band_keys(s, factors, offsets)) for s in (shingles_of(x, shingle) for x in batch)]
            yield pd.DataFrame({"fp": [x for x, _ in signs], "keys": [x for _, x in signs]})

    signed = F.pandas_udf(sign, "fp long, keys array<long>")(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), signed.alias("s"))
    rows = stage(rows.select("doc_id", "text_hash", "s.fp", "s.keys"), "signatures")
    nodes = rows.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys"))
    banded = nodes.select("fp", F.posexplode("keys").alias("band", "key"))
    least = banded.groupBy("band", "key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = banded.join(least, ["band", "key"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    pools = stage(connected_components(met).select(F.col("node").alias("fp"), F.col("root").alias("pool")), "pools")

    sizes = pools.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("pieces"))
    one_text = nodes.select("fp", "text_hash").join(pools, "fp").join(sizes, "pool")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(one_text, "text_hash").dropDuplicates(["fp"])

    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles_of(x, shingle).tobytes() for x in batch], dtype="object")

    held = stage(texts.select("pool", "pieces", "fp", F.pandas_udf(sets_of, "binary")("text").alias("shingles")), "shingle-sets")
    held = held.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    held = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    key = ["pool", "i", "j"]
    held = held.select("pool", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "fp", "shingles")
    dealt = held.repartition(*key).sortWithinPartitions(*key, "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def linked() -> pa.RecordBatch:
            pairs = similar_pairs(sets, similarity)
            return pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a, _ in pairs], pa.int64()), pa.array([names[b] for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for *group, name, shingles in zip(*[batch[c].to_pylist() for c in (*key, "fp", "shingles")]):
                if group != now:
                    if len(names) > 1:
                        yield linked()
                    now, names, sets = group, [], []
                names.append(name)
                sets.append(np.frombuffer(shingles, np.uint64))
        if len(names) > 1:
            yield linked()

    return _named(rows.drop("keys"), dealt.mapInArrow(compare, "a long, b long").distinct())


def keep_one(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component: the one whose id names it.

    ``rows`` are the components, those of ``near_duplicates`` unless given. A component without
    any id keeps one row per fingerprint. Of repeated rows one stays.
    """
    rows = near_duplicates(docs) if rows is None else rows
    own = unused(docs, "text_hash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "fp"))
    keepers = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_fp")).agg(best.alias("k"))
    keepers = keepers.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    same = hashed["doc_id"].cast("long").eqNullSafe(keepers["_id"]) & (hashed[own] == keepers["_hash"])
    kept = hashed.join(keepers, same, "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
