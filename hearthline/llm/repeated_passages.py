"""Removal of repeated byte passages by a distributed difference-cover scheme.

A byte goes when some string of ``length`` bytes over it starts anywhere else as well. Sorting
all suffixes of the corpus would tell; the difference cover makes that affordable:

1. *Sample.* D is a perfect difference set modulo v (307 for length 400). Any two positions i, j
   have a shift d < v with both i+d and j+d on D, so two equal strings always meet in a pair of
   sampled positions with equal next ``length - v + 1`` bytes. Only 18 of 307 positions count.
2. *Name.* Sampled positions are named by those bytes; names are sorted, equal neighbours found.
3. *Recurse.* A name that occurs once decides everything that rests on it and is discarded.
   What rests on shared names goes to the next level.
4. *Merge.* The remaining positions of whole strings are named by all ``length`` bytes, sorted,
   and adjacent ones compared: equal names mark both.

Names are 64-bit hashes (40 bits of them at the first level, where a false hit only costs work)
and travel in packed columns, one row per block of texts and range of names, so that a position
costs a few bytes. Each range of names is sorted by one task; the number of ranges follows the
data. Before the shuffle each block finds its own repeats, marks them, and sends on a single
member: a passage that a third of all documents share costs a range one row per block. Equal
texts are one text to all this (copies are handled by count), so nothing grows with the number
of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table

LENGTH = 400
RANGE_ROWS = 1_000_000  # names a task sorts at once
CHUNK_BYTES = 6 << 20
PACKED = "range int, tids binary, counts binary, positions binary, names binary, shared binary"
_PACKED_ARROW = pa.schema([("range", pa.int32()), *[(c, pa.binary()) for c in ("tids", "counts", "positions", "names", "shared")]])
_MARKED_ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("tids", "counts", "positions")]])
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def difference_set(q: int) -> tuple[int, ...]:
    """A perfect difference set modulo q*q+q+1 for a prime q (Singer): a plane of GF(q^3).

    Powers of a root of x^3 = c2 x^2 + c1 x + c0 run through all points of the projective plane
    for a suitable choice; the exponents of those without x^2 term form the set.
    """
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):
                point, found = (1, 0, 0), []
                for k in range(v):
                    if point[2] == 0:
                        found.append(k)
                    a, b, c = point
                    point = ((c * c0) % q, (a + c * c1) % q, (b + c * c2) % q)
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return tuple(found)
    raise ValueError(f"no difference set for {q}")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """Modulus and set of the widest cover that leaves at least a fifth of ``length`` to name by."""
    for q in (17, 13, 11, 7, 5, 3, 2):
        if q * q + q + 1 <= length * 4 // 5:
            return q * q + q + 1, difference_set(q)
    return 1, (0,)


_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def window_names(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name of every ``width`` bytes of ``data``: equal bytes, equal name."""
    n = len(data)
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[data] * up[:n], out=total[1:])
    x = (total[width:] - total[:n - width + 1]) * down[:n - width + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Packer:
    """Collects (text, position, name) and packs them by range of names."""

    def __init__(self, ranges: int, name_bytes: int) -> None:
        self.ranges, self.name_bytes = ranges, name_bytes
        self.clear()

    def clear(self) -> None:
        self.tids: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, tid: bytes, positions: np.ndarray, names: np.ndarray) -> None:
        if tid in self.tids or not len(positions):
            return  # a copy of a text in this block
        self.tids[tid] = len(self.tids)
        self.parts.append((np.full(len(names), self.tids[tid], np.int64), positions.astype(np.int64), names))

    def flush(self) -> Iterator[dict]:
        if not self.parts:
            return
        text, position, name = (np.concatenate(x) for x in zip(*self.parts))
        if self.name_bytes < 8:
            name = name & ~np.uint64((1 << (8 * (8 - self.name_bytes))) - 1)
        tids = list(self.tids)
        order = np.argsort(name)
        text, position, name = text[order], position[order], name[order]
        first = np.concatenate(([True], name[1:] != name[:-1]))
        starts = np.flatnonzero(first)
        run = np.diff(np.append(starts, len(name)))
        repeated = np.repeat(run > 1, run)
        yield from self._rows(tids, text[repeated], position[repeated], None, None)
        text, position, name, shared = text[starts], position[starts], name[starts], run > 1
        bounds = np.searchsorted(_range_of(name, self.ranges), np.arange(self.ranges + 1))
        for k in range(self.ranges):
            own = slice(bounds[k], bounds[k + 1])
            yield from self._rows(tids, text[own], position[own], name[own], shared[own], k)
        self.clear()

    def _rows(self, tids, text, position, name, shared, at: int = -1) -> Iterator[dict]:
        """One packed row; without names it holds positions that are settled already."""
        if not len(text):
            return
        order = np.lexsort((position, text))
        text, position = text[order], position[order]
        starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        counts = np.diff(np.append(starts, len(text)))
        step = np.diff(position, prepend=0)
        step[starts] = position[starts]
        row = {
            "range": at, "tids": b"".join(tids[k] for k in text[starts]), "counts": counts.astype("<u4").tobytes(),
            "positions": step.astype("<u4").tobytes(), "names": None, "shared": None,
        }
        if name is not None:
            row["names"] = name[order].view(np.uint8).reshape(-1, 8)[:, 8 - self.name_bytes:].tobytes()
            row["shared"] = np.packbits(shared[order]).tobytes()
        yield row


def _range_of(name: np.ndarray, ranges: int) -> np.ndarray:
    return ((name >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text ids (16 bytes each, one per position) as indices, ids, and positions."""
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    position = np.frombuffer(row["positions"], "<u4").astype(np.int64)
    ends = np.cumsum(counts)
    total = np.cumsum(position)
    before = np.concatenate(([0], total[ends[:-1] - 1]))
    return np.repeat(np.arange(len(counts)), counts), np.frombuffer(row["tids"], "V16"), total - np.repeat(before, counts)


def _settled(tids: np.ndarray, text: np.ndarray, position: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marked positions packed by bucket of texts; ``text`` indexes ``tids``."""
    if not len(text):
        return
    bucket_of = np.ascontiguousarray(tids).view("<u4").reshape(-1, 4)[:, 0] % np.uint32(buckets)
    bucket = bucket_of[text]
    order = np.lexsort((position, text, bucket))
    text, position, bucket = text[order], position[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        own, place = text[a:b], position[a:b]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        step = np.diff(place, prepend=0)
        step[starts] = place[starts]
        rows.append({
            "bucket": int(bucket[a]), "tids": tids[own[starts]].tobytes(),
            "counts": np.diff(np.append(starts, len(own))).astype("<u4").tobytes(), "positions": step.astype("<u4").tobytes(),
        })
    yield pa.RecordBatch.from_pylist(rows, schema=_MARKED_ARROW)


def _by_text(marked: DataFrame, buckets: int) -> DataFrame:
    """One row (tid, positions) for each text that has a marked position."""

    def merge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        texts, ids, positions, base = [], [], [], 0
        for row in rows:
            text, tids, position = _unpack(row)
            texts.append(text + base)
            ids.append(tids)
            positions.append(position)
            base += len(tids)
        tids, same = np.unique(np.concatenate(ids), return_inverse=True)
        text, position = same[np.concatenate(texts)], np.concatenate(positions)
        order = np.lexsort((position, text))
        text, position = text[order], position[order]
        starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes() for x in tids], pa.binary()),
             pa.array([position[a:b].astype("<u4").tobytes() for a, b in zip(starts, np.append(starts[1:], len(text)))], pa.binary())],
            ["tid", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from merge(held)
                    held = []
                held.append(row)
        if held:
            yield from merge(held)

    return marked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "tid binary, positions binary")


def _settle_range(rows: list[dict], name_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Positions of one range whose name occurs at two places or was shared before."""
    texts, ids, positions, names, shared = [], [], [], [], []
    base = 0
    for row in rows:
        text, tids, position = _unpack(row)
        texts.append(text + base)
        ids.append(tids)
        base += len(tids)
        positions.append(position)
        wide = np.zeros((len(position), 8), np.uint8)
        wide[:, 8 - name_bytes:] = np.frombuffer(row["names"], np.uint8).reshape(-1, name_bytes)
        names.append(wide.view(np.uint64).ravel())
        shared.append(np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=len(position)).astype(bool))
    tids, same = np.unique(np.concatenate(ids), return_inverse=True)
    text, position = same[np.concatenate(texts)], np.concatenate(positions)
    name, many = np.concatenate(names), np.concatenate(shared)
    order = np.argsort(name)
    name, text, position, many = name[order], text[order], position[order], many[order]
    starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    # A run counts as repeated if it has two different places; copies of a text are one place.
    low_t, high_t = np.minimum.reduceat(text, starts), np.maximum.reduceat(text, starts)
    low_p, high_p = np.minimum.reduceat(position, starts), np.maximum.reduceat(position, starts)
    hit = (low_t != high_t) | (low_p != high_p) | np.logical_or.reduceat(many, starts)
    kept = np.repeat(hit, np.diff(np.append(starts, len(name))))
    text, position = text[kept], position[kept]
    order = np.lexsort((position, text))
    text, position = text[order], position[order]
    if len(text):
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (position[1:] != position[:-1])))
        text, position = text[new], position[new]
    yield from _settled(tids, text, position, buckets)


def _settle(packed: DataFrame, ranges: int, name_bytes: int) -> DataFrame:
    """Rows (tid, positions): the marked positions of each text."""
    buckets = max(1, ranges // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] < 0:
                    text, tids, position = _unpack(row)
                    yield from _settled(tids, text, position, buckets)
                    continue
                if held and held[0]["range"] != row["range"]:
                    yield from _settle_range(held, name_bytes, buckets)
                    held = []
                held.append(row)
        if held:
            yield from _settle_range(held, name_bytes, buckets)

    spread = F.when(F.col("range") < 0, F.xxhash64("tids")).otherwise(F.lit(0))
    dealt = packed.repartition(ranges, "range", spread).sortWithinPartitions("range")
    return _by_text(dealt.mapInArrow(run, "bucket int, tids binary, counts binary, positions binary"), buckets)


def _chunks(batches: Iterator[pa.RecordBatch], packer: Packer, places) -> Iterator[pa.RecordBatch]:
    """Feed every text to ``places`` (which gives positions and names), packing block by block."""
    for batch in batches:
        rows = batch.to_pydict()
        for k, tid in enumerate(rows["tid"]):
            data = np.frombuffer(rows["text"][k].encode(), np.uint8)
            packer.add(tid, *places(data, rows["flags"][k] if "flags" in rows else None))
            packer.size += len(data)
            if packer.size >= CHUNK_BYTES:
                for row in packer.flush():
                    yield pa.RecordBatch.from_pylist([row], schema=_PACKED_ARROW)
                packer.size = 0
    for row in packer.flush():
        yield pa.RecordBatch.from_pylist([row], schema=_PACKED_ARROW)


def candidates(n: int, flags: bytes, length: int, modulus: int) -> np.ndarray:
    """Starts of whole strings in a text of ``n`` bytes that rest on a shared name."""
    p = np.frombuffer(flags, "<u4").astype(np.int64)
    last = n - length + 1
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(p - modulus + 1, 0), 1)
    np.add.at(edge, np.minimum(p, last - 1) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:last] > 0)


def repeated_starts(docs: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Staged texts that may hold repeats (tid, text, flags) and rows (tid, positions) of their repeats.

    ``tid`` is the md5 of a text; equal texts are one text here.
    """
    modulus, cover = cover_for(length)
    width = length - modulus + 1
    marked = np.zeros(modulus, bool)
    marked[list(cover)] = True
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), "text").where(F.octet_length("text") >= length)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-int(total * len(cover) / modulus) // range_rows))

    def sampled(data: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        p = np.arange(len(data) - width + 1)
        p = p[marked[p % modulus]]
        return p, window_names(data, width)[p]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, Packer(ranges, 5), sampled)

    hits = stage(_settle(texts.mapInArrow(sample, PACKED), ranges, 5), "shared-names")
    size = hits.agg(F.sum(F.octet_length("positions"))).first()[0] or 0
    flagged = hits.select("tid", F.col("positions").alias("flags"))
    whole = texts.groupBy("tid").agg(F.first("text").alias("text"))
    resting = stage(whole.join(flagged, "tid"), "resting-texts")
    drop_staged(hits)
    ranges = max(1, -(-int(size / 4 * modulus / len(cover)) // range_rows))

    def remaining(data: np.ndarray, flags: bytes) -> tuple[np.ndarray, np.ndarray]:
        p = candidates(len(data), flags, length, modulus)
        return p, window_names(data, length)[p]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunks(batches, Packer(ranges, 8), remaining)

    return resting, stage(_settle(resting.mapInArrow(merge, PACKED), ranges, 8), "repeats")


def cut(text: str, positions: bytes, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs [a, b) of bytes and the bytes that stay."""
    data = text.encode()
    p = np.unique(np.frombuffer(positions, "<u4").astype(np.int64))
    breaks = np.flatnonzero(np.diff(p) > length)
    starts, ends = p[np.concatenate(([0], breaks + 1))], p[np.append(breaks, len(p) - 1)] + length
    spans = list(zip(starts.tolist(), ends.tolist()))
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return spans, b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    ``spans`` are the removed runs [start, end) in bytes, ``kept`` the bytes left (null where
    nothing is removed: the text itself). A null text is empty. A text of ``length`` bytes or
    more that occurs twice goes whole, repeated rows included. Ids are not interpreted.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # shuffle files of a step go once it is written
    try:
        resting, repeats = repeated_starts(docs, length, range_rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    spans, kept = cut(row["text"], row["positions"], length)
                    out.append({
                        "tid": row["tid"], "n_removed": sum(b - a for a, b in spans), "spans": [list(x) for x in spans],
                        "kept": kept, "sha": hashlib.sha256(kept).hexdigest(),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_CUT_ARROW)

        cuts = stage(
            resting.select("tid", "text").join(repeats, "tid")
            .mapInArrow(run, "tid binary, n_removed long, spans array<array<long>>, kept binary, sha string"), "cuts",
        )
        drop_staged(resting, repeats)
    finally:
        spark.conf.set(CLEANUP, before)
    base = docs.select(
        "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("whole"),
    )
    copied = base.where(F.col("n_bytes") >= length).groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = F.col("copies").isNotNull()
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return base.join(copied, "tid", "left").join(cuts, "tid", "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(gone, everything).otherwise(F.col("spans")).alias("spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


_CUT_ARROW = pa.schema([
    ("tid", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("sha", pa.string()),
])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
