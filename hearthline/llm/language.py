"""Language of texts by prediction by partial matching (PPM).

1. Every language has a tree of byte contexts of up to ``order`` bytes: how often each byte
   followed each context in the lower-cased training texts. Tasks count whole texts piecewise;
   Spark adds the counts of all documents, so what is gathered grows with the corpus.
2. The tree that scoring carries is bounded by ``max_nodes``: of each language, the nodes counted
   most often. A node's shorter contexts are counted at least as often, so they stay too.
3. Statistics are then frozen. The code length of a byte is exact PPM, escape method C with
   exclusion: the longest known context codes it, or escapes to the next shorter one, which no
   longer offers the bytes that the longer one had; below the empty context all bytes not yet
   offered are equally likely. In every context the probabilities of the 256 bytes add up to one.
4. A text gets the language whose tree codes it shortest.

Different windows of ``order`` + 1 bytes of a piece are coded once, however often they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table

ORDER = 4
PIECE = 1 << 20  # bytes counted or coded at a time
HELD = 1_000_000  # nodes a counting task holds before it passes them on
NODES = 400_000  # nodes of all trees that scoring carries, 16 bytes each
LANGUAGES = 512  # trees at most: those of most training bytes
UNKNOWN = "und"


# --- windows ---------------------------------------------------------------------------------


def pieces(texts: Iterator[str], order: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts packed into pieces of about ``size`` bytes: windows, owners, starts, ends.

    A window is a byte with the ``order`` bytes before it (zeros before a text), packed into one
    number, the byte lowest. Windows from ``starts[i]`` to ``ends[i]`` belong to text
    ``owners[i]``; those between are of no text. Texts longer than a piece go on in the next one
    with their context.
    """
    pad = bytes(order)
    parts: list[bytes] = []
    owners: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    filled = 0

    def finish():
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data) - order
        windows = np.zeros(n, np.uint64)
        for k in range(order + 1):
            windows = windows << np.uint64(8) | data[k:n + k]
        found = windows, np.array(owners), np.array(starts), np.array(ends)
        for x in (parts, owners, starts, ends):
            x.clear()
        return found

    for owner, text in enumerate(texts):
        data = text.lower().encode("utf-8", "surrogatepass")
        before, at = pad, 0
        while at < len(data):
            own = data[at:at + size - filled]
            parts += [before, own]
            owners.append(owner)
            starts.append(filled)
            ends.append(filled + len(own))
            filled += order + len(own)
            at += len(own)
            before = (before + own)[-order:] if order else b""
            if filled >= size:
                yield finish()
                filled = 0
    if parts:
        yield finish()


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# --- counting --------------------------------------------------------------------------------


def _count(order: int):
    """Batches of (lang, text) to (lang, window, n), summed within the task as far as HELD allows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "window", "n"]
                )
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            order_of = sorted(range(len(langs)), key=lambda r: langs[r])
            texts = batch.column(1)
            ranked = [langs[r] for r in order_of]
            for windows, owners, starts, ends in pieces((texts[r].as_py() for r in order_of), order):
                names = [ranked[o] for o in owners]
                for lang in dict.fromkeys(names):
                    mine = [(a, b) for a, b, name in zip(starts, ends, names) if name == lang]
                    keys, counts = np.unique(np.concatenate([windows[a:b] for a, b in mine]), return_counts=True)
                    old = held.get(lang)
                    held[lang] = (keys, counts) if old is None else _merged(np.concatenate([old[0], keys]), np.concatenate([old[1], counts]))
                if sum(len(k) for k, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    return run


def count_nodes(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Nodes of all trees over ``rows`` (lang, text, neither null): lang, depth, node, n.

    A node of depth k is a byte below its k bytes of context, packed into a long.
    """
    windows = rows.select("lang", "text").mapInArrow(_count(order), "lang string, window long, n long")
    whole = stage(windows.groupBy("lang", "window").agg(F.sum("n").alias("n")), "windows")
    suffix = [F.struct(F.lit(k).alias("depth"), F.col("window").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("node")) for k in range(order + 1)]
    each = whole.select("lang", "n", F.explode(F.array(*suffix)).alias("at")).select("lang", "at.*", "n")
    nodes = stage(each.groupBy("lang", "depth", "node").agg(F.sum("n").alias("n")), "nodes")
    drop_staged(whole)
    return nodes


def frequent(nodes: DataFrame, max_nodes: int, max_languages: int) -> tuple[DataFrame, tuple[str, ...]]:
    """At most ``max_nodes`` of staged ``nodes``, of each language those above one count; and the languages, sorted.

    The nodes name their language by its place.

    The count is the least, in steps of an eighth of a doubling, that leaves a language its share
    of ``max_nodes``. Of more than ``max_languages`` languages those of most bytes stay.
    """
    spoken = nodes.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(max_languages)
    chosen = sorted(r.lang for r in spoken.collect())  # at most max_languages
    share = max_nodes // max(1, len(chosen))
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = nodes.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("size"))
    # A language has at most 8 x 63 steps.
    above = F.sum("size").over(W.partitionBy("lang").orderBy(F.desc("step")))
    least = sizes.select("lang", "step", above.alias("above")).where(F.col("above") <= share).groupBy("lang").agg(F.min("step").alias("least"))
    known = nodes.sparkSession.createDataFrame(list(enumerate(chosen)), "place int, lang string")
    wanted = nodes.withColumn("step", step).join(least.join(known, "lang"), "lang").where("step >= least")
    return wanted.select(F.col("place").alias("lang"), "depth", "node", "n"), tuple(chosen)


# --- frozen trees ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Depth:
    """Contexts of one length in one tree, and the bytes below them."""

    nodes: np.ndarray  # context and byte, ascending
    counts: np.ndarray
    contexts: np.ndarray  # ascending
    total: np.ndarray  # of a context's counts
    distinct: np.ndarray  # bytes below a context
    above: np.ndarray  # counts of those bytes below the next shorter context


@dataclass(frozen=True)
class Tree:
    depths: tuple[Depth, ...]

    def code_lengths(self, windows: np.ndarray) -> np.ndarray:
        """Bits for the lowest byte of each window after the bytes above it."""
        bits = np.zeros(len(windows))
        at = np.arange(len(windows))
        offered, mass = np.zeros(len(windows)), np.zeros(len(windows))  # bytes excluded, and their counts here
        for k in range(len(self.depths) - 1, -1, -1):
            depth = self.depths[k]
            if not len(at):
                return bits
            if not len(depth.nodes):
                continue
            node = windows[at] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(depth.contexts, node >> np.uint64(8)), len(depth.contexts) - 1)
            known = depth.contexts[c] == node >> np.uint64(8)
            e = np.minimum(np.searchsorted(depth.nodes, node), len(depth.nodes) - 1)
            seen = depth.nodes[e] == node
            novel = depth.distinct[c] - offered
            whole = depth.total[c] - mass + novel
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(seen, np.log2(whole) - np.log2(depth.counts[e]), np.where(known & (novel > 0), np.log2(whole) - np.log2(novel), 0.0))
            bits[at] += cost
            left = ~seen
            offered, mass = np.where(known, depth.distinct[c], offered)[left], np.where(known, depth.above[c], mass)[left]
            at = at[left]
        bits[at] += np.log2(256.0 - offered)
        return bits


def build(nodes: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """A tree from (node, count) arrays by depth, nodes ascending."""
    depths = []
    for k, (node, count) in enumerate(nodes):
        context = node >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(node) else np.zeros(0, np.int64)
        above = np.zeros(len(node))
        if k and len(node):
            shorter = nodes[k - 1]
            above = shorter[1][np.searchsorted(shorter[0], node & np.uint64((1 << 8 * k) - 1))].astype(np.float64)
        sums = (lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0))
        depths.append(Depth(node, count.astype(np.float64), context[first], sums(count.astype(np.float64)), np.diff(np.append(first, len(node))).astype(np.float64), sums(above)))
    return Tree(tuple(depths))


@dataclass(frozen=True)
class Languages:
    """Frozen trees by language. ``packed`` has, by language, the nodes and counts of each depth."""

    names: tuple[str, ...]
    order: int
    packed: tuple[list[tuple[np.ndarray, np.ndarray]], ...]
    token: str

    def trees(self) -> list[Tree]:
        """Built once in a worker."""
        if _built.get("token") != self.token:
            _built.clear()
            _built.update(token=self.token, trees=[build(x) for x in self.packed])
        return _built["trees"]

    def code_lengths(self, texts: list[str], size: int = PIECE) -> np.ndarray:
        """Bits of each text in each language."""
        trees = self.trees()
        bits = np.zeros((len(texts), len(trees)))
        for windows, owners, starts, ends in pieces(iter(texts), self.order, size):
            distinct, place = np.unique(windows, return_inverse=True)
            for k, tree in enumerate(trees):
                run = np.concatenate([[0.0], np.cumsum(tree.code_lengths(distinct)[place])])
                np.add.at(bits[:, k], owners, run[ends] - run[starts])
        return bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        scored = [r for r, t in enumerate(texts) if self.names and t is not None and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if scored:
            bits = self.code_lengths([texts[r] for r in scored])
            best = np.argmin(bits, axis=1)  # the first of equal ones
            weight = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            for r, b, p in zip(scored, best, 1 / weight.sum(axis=1)):
                names[r], scores[r] = self.names[b], p
        return names, scores


_built: dict = {}


def fit(rows: DataFrame, order: int = ORDER, max_nodes: int = NODES, max_languages: int = LANGUAGES) -> Languages:
    """Trees from ``rows`` (lang, text); rows with a null in either teach nothing.

    ``order`` is at most 6, so that a window fits a long.
    """
    if not 0 <= order <= 6:
        raise ValueError("order 0 to 6")
    usable = rows.select(F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    nodes = count_nodes(usable, order)
    held, names = frequent(nodes, max_nodes, max_languages)
    found = held.select("lang", "depth", "node", "n").toArrow()  # at most max_nodes rows of numbers
    drop_staged(nodes)
    lang, depth, node, n = (found.column(k).to_numpy() for k in range(4))
    place = np.lexsort((node, depth, lang))
    lang, depth, node, n = lang[place], depth[place], node[place].astype(np.uint64), n[place]
    cuts = np.searchsorted(lang.astype(np.int64) * 8 + depth, np.arange(len(names) * 8 + 1))
    packed = [[(node[cuts[8 * k + d]:cuts[8 * k + d + 1]], n[cuts[8 * k + d]:cuts[8 * k + d + 1]]) for d in range(order + 1)] for k in range(len(names))]
    return Languages(names, order, tuple(packed), uuid.uuid4().hex)


def language(text: str, model: Languages, spark: SparkSession) -> Column:
    """Struct (lang_pred string, score double) of a text column.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no
    language was learned; of equally short codes the language that sorts first counts. The score
    is the posterior of the language, all being equally likely beforehand. Texts are coded whole.
    """
    shared = spark.sparkContext.broadcast(model)  # max_nodes bounds it

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = shared.value.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: Languages, into: str = "language") -> DataFrame:
    """``docs`` with the struct of :func:`language` in column ``into``, which must be a new one."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {into} already")
    return docs.withColumn(into, language("text", model, docs.sparkSession))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
