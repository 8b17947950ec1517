"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

1. Entries become integers, x = floor(64 c) + 1,000,000, so all sums are exact whatever their order.
   Vectors are packed to bytes as narrow as their entries allow; equal vectors collapse in a
   combining aggregate, and what is left is staged: the fit list.
2. One pass sums the fit list (n, S), a second the products of entries centred at the whole
   numbers next to the means. Partial sums leave a task as limbs of 40 bits and add up in Spark;
   the exact n^2 V follows.
3. On the driver, on a matrix as large as the square of the dimension: Cholesky with diagonal
   pivoting gives n^2 V = L L'. Jacobi rotations make the columns of L orthogonal. Their squared
   norms are the eigenvalues, the normalised columns the components. Small eigenvalues keep their
   relative accuracy, since the factor isn't squared again.
4. Whitening is a matrix product in the task that holds the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table

SCALE, OFFSET = 64.0, 1_000_000
WIDTHS = (1, 2, 4, 8)
LIMB = 40  # bits of a limb
LIMBS = 5  # 5 x 40 bits hold any sum of products of entries that fit a long
ROWS = 4096  # vectors multiplied at a time


# --- packing -------------------------------------------------------------------------------


def whole_numbers(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of entries as integers less OFFSET, and which rows take part.

    Non-finite entries rule a row out, as does one whose integer a long doesn't hold (beyond
    about 1.4e17).
    """
    scaled = np.floor(np.asarray(entries, np.float64) * SCALE)
    held = np.abs(scaled) < 2.0 ** 63 - 2 ** 22  # false for NaN
    return np.where(held, scaled, 0.0).astype(np.int64), held.all(axis=1)


def pack(rows: np.ndarray) -> list[bytes]:
    """Equal rows, and no others, have equal bytes: a width, then the entries as narrow as they all fit."""
    out: list[bytes] = [b""] * len(rows)
    if not len(rows):
        return out
    low, high = rows.min(axis=1), rows.max(axis=1)
    bits = [8 * w - 1 for w in WIDTHS]
    fits = np.stack([(low >= -(1 << b)) & (high <= (1 << b) - 1) for b in bits], axis=1)
    kind = np.argmax(fits, axis=1)
    for k, w in enumerate(WIDTHS):
        mine = np.flatnonzero(kind == k)
        raw, size, head = rows[mine].astype(f"<i{w}").tobytes(), rows.shape[1] * w, bytes([w])
        for place, r in enumerate(mine.tolist()):
            out[r] = head + raw[place * size:(place + 1) * size]
    return out


def unpack(packed: list[bytes]) -> np.ndarray:
    """Rows of entries less OFFSET; all of one dimension."""
    rows = np.empty((len(packed), (len(packed[0]) - 1) // packed[0][0]), np.int64)
    widths = np.array([p[0] for p in packed])
    for w in np.unique(widths):
        mine = np.flatnonzero(widths == w)
        raw = np.frombuffer(b"".join([packed[r] for r in mine]), np.uint8).reshape(len(mine), -1)[:, 1:]
        rows[mine] = np.ascontiguousarray(raw).view(f"<i{w}")
    return rows


def pack_column(column: pa.Array) -> pa.Array:
    """A column of lists of doubles, packed; null where the vector takes no part."""
    out: list[bytes | None] = [None] * len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        mine = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(mine)).flatten()
        whole, held = whole_numbers(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(mine), size))
        for r, data in zip(mine[held].tolist(), pack(whole[held])):
            out[r] = data
    return pa.array(out, pa.binary())


def packed(df: DataFrame, vector: str, kept: list[str]) -> DataFrame:
    """Columns ``kept`` with ``packed``, null where the vector takes no part."""
    names = [f"k{k}" for k in range(len(kept))]
    read = df.select(*[F.col(c).alias(n) for c, n in zip(kept, names)], F.col(vector).cast("array<double>").alias("vector"))
    fields = ", ".join(f"{n} {t}" for n, t in read.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pack_column(batch.column(len(names)))], names=[*names, "packed"])

    return read.mapInArrow(run, f"{fields}{', ' if fields else ''}packed binary")


# --- exact sums -----------------------------------------------------------------------------


def limbs(value: int) -> list[int]:
    """``value`` as LIMBS signed limbs, lowest first; all but the last are not negative."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def joined(parts: list[int]) -> int:
    return sum(int(p) << LIMB * k for k, p in enumerate(parts))


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers. y: rows x entries, whole numbers (int64, or any integers)."""
    top = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if top * top * max(1, len(y)) < 1 << 53:  # every partial sum is exact in double precision
        z = y.astype(np.float64)
        return np.rint(z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _summed(rows: DataFrame, cells) -> dict[tuple[int, int], int]:
    """Sums over the tasks' (i, j, value) triples. ``cells`` maps an iterator of vector blocks to them."""
    fields = ", ".join(f"l{k} long" for k in range(LIMBS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                column = batch.column(0)
                for k in range(0, len(column), ROWS):
                    yield unpack(column.slice(k, ROWS).to_pylist())

        found = [(i, j, *limbs(v)) for i, j, v in cells(blocks())]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], schema=schema)

    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(f"l{k}", pa.int64()) for k in range(LIMBS)]])
    parts = rows.select("packed").mapInArrow(run, f"i int, j int, {fields}")
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(LIMBS)])
    return {(r[0], r[1]): joined(list(r)[2:]) for r in sums.collect()}  # at most the squared dimension


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and, for each entry, the exact sum of x - OFFSET over packed ``rows`` of one dimension."""
    def cells(blocks):
        n, total = 0, None
        for y in blocks:
            part = y.astype(object).sum(axis=0) if np.abs(y.astype(np.float64)).max() > 2 ** 50 else y.sum(axis=0).astype(object)
            n, total = n + len(y), part if total is None else total + part
        if n:
            yield -1, -1, n
            yield from ((i, -1, int(v)) for i, v in enumerate(total))

    found = _summed(rows, cells)
    n = found.pop((-1, -1), 0)
    return n, [found[i, -1] for i in range(len(found))]


def scatter(rows: DataFrame, n: int, total: list[int]) -> list[list[int]]:
    """n^2 times the covariance, exactly: n sum(y y') - sum(y) sum(y)', y centred at the nearest whole number."""
    centre = [(2 * s + n) // (2 * n) for s in total]
    small = all(abs(c) < 1 << 62 for c in centre)

    def cells(blocks):
        products = None
        for y in blocks:
            wide = np.abs(y.astype(np.float64)).max() > 2 ** 61 or not small
            part = exact_products(y.astype(object) - np.array(centre, object) if wide else y - np.array(centre, np.int64))
            products = part if products is None else products + part
        if products is not None:
            for i in range(len(products)):
                yield from ((i, j, int(products[i, j])) for j in range(i + 1))

    found = _summed(rows, cells)
    rest = [s - n * c for s, c in zip(total, centre)]
    size = len(total)
    return [[n * found[max(i, j), min(i, j)] - rest[i] * rest[j] for j in range(size)] for i in range(size)]


# --- decomposition ---------------------------------------------------------------------------


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L' for positive semidefinite ``a``; rows in the order of ``a``, one column per pivot.

    The next pivot is the largest diagonal entry left. Ends when none is above rounding, so the
    number of columns is the numerical rank.
    """
    size = len(a)
    rest, left = np.diag(a).astype(np.float64).copy(), np.ones(size, bool)
    factor = np.zeros((size, size))
    least = size * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(size):
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if not rest[p] > least:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(rest[p])
        column[~left] = 0.0
        column[p] = np.sqrt(rest[p])
        factor[:, k] = column
        left[p] = False
        rest = np.where(left, rest - column * column, 0.0)
    return factor


def one_sided_jacobi(factor: np.ndarray, max_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and normalised columns of ``factor`` once they are orthogonal.

    Disjoint pairs of columns rotate together, in the rounds of a round-robin tournament. Ends
    when no pair's cosine is above rounding in a whole sweep.
    """
    g = factor.copy()
    size = g.shape[1]
    if size == 0:
        return np.zeros(0), g
    seats = list(range(size)) + [-1] * (size % 2)
    tolerance = np.finfo(float).eps * np.sqrt(len(g))
    for _ in range(max_sweeps):
        turned = False
        for _ in range(max(1, len(seats) - 1)):
            pairs = [(p, q) for p, q in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2:])) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs))
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            act = np.abs(ab) > tolerance * np.sqrt(aa * bb)
            if not act.any():
                continue
            turned = True
            p, q, a, b, aa, bb, ab = p[act], q[act], a[:, act], b[:, act], aa[act], bb[act], ab[act]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (a - t * b), c * (b + t * a)
        if not turned:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    g, values = g[:, order], values[order]
    held = values > 0
    g, values = g[:, held], values[held]
    vectors = g / np.sqrt(values)
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


# --- model ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors, sums S of x - OFFSET, components as columns, eigenvalues of x's covariance."""

    n: int
    total: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros(0)

    def offsets(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exactly: int64 where it fits, else Python integers."""
        top = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        if top * self.n + max(map(abs, self.total)) < 1 << 62:
            return y * np.int64(self.n) - np.array(self.total, np.int64)
        return y.astype(object) * self.n - np.array(self.total, object)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of squares of n x - S for each row; None if a long doesn't hold it."""
        d = self.offsets(y)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * y.shape[1] >= 2.0 ** 62:
            d = d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]

    def whitened(self, y: np.ndarray, k: int) -> np.ndarray:
        """Rows projected on the first ``k`` components, over the roots of their eigenvalues."""
        centred = (self.offsets(y) / self.n).astype(np.float64)
        return centred @ self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def fit_list(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The distinct usable vectors, staged (``packed``), and their dimension.

    The dimension is that of most rows (the larger of two equally frequent); vectors of another
    length hold no entry where the others do, and take no part. 0 if no vector is usable.
    """
    all_rows = packed(df, vector, []).where("packed IS NOT NULL")
    size = (F.length("packed") - 1) / F.ascii(F.substring("packed", 1, 1).cast("string"))
    counted = stage(all_rows.groupBy("packed").count().select("packed", size.cast("int").alias("size"), "count"), "vectors")
    most = counted.groupBy("size").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return counted.where(F.col("size") == size), size


def fit(rows: DataFrame) -> Whitening | None:
    """Fit to staged distinct vectors; None without any.

    Directions without variance have no component: a single vector leaves none at all.
    """
    n, total = sums(rows)
    if not n:
        return None
    exact = scatter(rows, n, total)
    square = n * n
    # Scaled by a power of two, so that no entry overflows and no digit is lost.
    shift = max(0, max(exact[i][i] for i in range(len(exact))).bit_length() - 900)
    a = np.array([[float(v >> shift) if shift else float(v) for v in row] for row in exact])
    values, vectors = one_sided_jacobi(pivoted_cholesky(a))
    scale = float((1 << shift) / square)
    trace = float(sum(exact[i][i] for i in range(len(exact))) / square)
    return Whitening(n, tuple(total), vectors, values * scale, trace)


def identity_error(rows: DataFrame, model: Whitening, k: int) -> float:
    """Largest entry, in size, of the whitened fit list's covariance less the identity; one pass."""
    k = min(k, len(model.eigenvalues))
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                w = model.whitened(unpack(batch.column(0).slice(start, ROWS).to_pylist()), k)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    cells = rows.select("packed").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    found = np.zeros((k + 1, k))
    for i, j, v in cells:
        found[i, j] = v / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def transform(df: DataFrame, id_column: str, vector: str, model: Whitening | None, k: int) -> DataFrame:
    """Usable rows as (id, whitened array<double> of up to ``k`` components, deviation long)."""
    size = len(model.total) if model else 0
    kind = df.select(id_column).dtypes[0][1]
    rows = packed(df, vector, [id_column]).where("packed IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                data = part.column(1).to_pylist()
                mine = [r for r, x in enumerate(data) if len(x) == size * x[0] + 1]
                if not mine:
                    continue
                y = unpack([data[r] for r in mine])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(mine)), pa.array(list(model.whitened(y, min(k, len(model.eigenvalues)))), pa.list_(pa.float64())),
                     pa.array(model.deviations(y), pa.int64())],
                    names=["id", "whitened", "deviation"],
                )

    return rows.mapInArrow(run, f"id {kind}, whitened array<double>, deviation long")


def query(spark: SparkSession, sf_dir: str, components: int = 16) -> DataFrame:
    """Rows of ``embeddings`` by component.

    Null, empty and non-finite vectors are left out, as are those of another length than most.
    Repeated rows and ids stay as often as they come. Components without variance are left out;
    an empty table, or one distinct vector, gives no rows. A deviation beyond a long is null.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows, _ = fit_list(vectors, "embedding")
    model = fit(rows)
    error = identity_error(rows, model, components) if model else 0.0
    drop_staged(rows)
    explained = F.array(*[F.lit(float(v)) for v in model.explained[:components]]) if model and len(model.explained) else F.array().cast("array<double>")
    found = transform(vectors, "vec_id", "embedding", model, components)
    each = found.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
