"""Benchmark decontamination by latent semantic retrieval.

1. Weights are TF-IDF over the items' words; document frequencies count all documents.
2. Documents are cut into passages: windows of words, half overlapping, as wide as the items
   need. A window whose words shared with one item hold less than ``cosine**2`` of that item's
   weight cannot reach ``cosine``; only windows that may are written. (Each item's most common
   words, up to a quarter of that weight, are counted as shared without a look.)
3. A randomised SVD of items and written passages gives a latent space: two products with
   A'A (start and power iteration) and a Gram matrix, each an aggregation in Spark.
4. Pairs of passage and item with a latent cosine of ``cosine`` or more are candidates.
5. A candidate's stretch of the document is held against the item's words: the longest common
   subsequence must cover ``overlap`` of the item; from ``paraphrase`` to ``overlap`` the item's
   answer (column ``answer``, else its last sentence) must be found there as well.

The benchmark is taken in blocks of at most ``block_items`` items, so vocabulary, bases and
everything else that is broadcast or collected has a bound that documents don't move.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage, table, unused

WORD = re.compile(r"\w+")
#: Marks beyond ASCII; without them words can be cut from the bytes.
FOREIGN_MARK = re.compile(r"[^\x00-\x7f\w]")
BLANKS = bytes(x if x >= 128 or chr(x).isalnum() or x == 95 else 32 for x in range(256))
WIDTHS = (16, 32, 64, 128, 256, 512)
PASSAGE = pa.schema([
    ("tid", pa.int64()), ("terms", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("stretch", pa.list_(pa.binary())),
])
PASSAGE_DDL = "tid long, terms array<int>, weights array<double>, stretch array<binary>"


def words_of(text: str | None) -> list[bytes]:
    """The words ``\\w+`` of the lower-cased text, in UTF-8."""
    low = (text or "").lower()
    if FOREIGN_MARK.search(low):
        low = " ".join(WORD.findall(low))
    return low.encode().translate(BLANKS).split()


@dataclass(frozen=True)
class Items:
    """A block of benchmark items over one vocabulary."""

    ids: tuple
    words: tuple[tuple[bytes, ...], ...]
    answers: tuple[tuple[bytes, ...], ...]
    vocabulary: dict[bytes, int]

    def vectors(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), len(self.vocabulary)))
        for k, words in enumerate(self.words):
            np.add.at(out[k], [self.vocabulary[w] for w in words], 1.0)
        return out * weight


def read_items(rows: list) -> Items | None:
    """Items that have a word; the others can't be found anywhere."""
    kept = []
    for row in rows:
        words = words_of(row["text"])
        if words:
            named = words_of(row["answer"]) if "answer" in row else []
            sentences = [x for x in map(words_of, re.split(r"[.!?\n]+", row["text"])) if x]
            kept.append((row["item_id"], tuple(words), tuple(named or sentences[-1])))
    if not kept:
        return None
    ids, words, answers = zip(*kept)
    return Items(ids, words, answers, {w: k for k, w in enumerate(sorted({w for x in words for w in x}))})


def inverse_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """IDF of the items' words over all rows of ``docs``."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(size, np.int64)
        for batch in batches:
            for text in batch[0]:
                n += 1
                found[[vocabulary[w] for w in vocabulary.keys() & set(words_of(text.as_py()))]] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(found[held], n))], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n, found = 0, np.zeros(size)
    for r in counts:  # a row for each word of the block at most
        if r.word < 0:
            n = r.n
        else:
            found[r.word] = r.n
    return np.log((1.0 + n) / (1.0 + found)) + 1e-3


def shares(vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Each word's part of each item's weight (items x words; zero if taken for granted), and what an item still needs."""
    part = vectors ** 2 / (vectors ** 2).sum(axis=1, keepdims=True)
    order = np.argsort(part, axis=1, kind="stable")
    granted = np.zeros(part.shape, bool)
    np.put_along_axis(granted, order, np.cumsum(np.take_along_axis(part, order, axis=1), axis=1) <= cosine ** 2 / 4, axis=1)
    need = cosine ** 2 - np.where(granted, part, 0.0).sum(axis=1) - 1e-9
    return np.where(granted, 0.0, part), need


def passages(docs: DataFrame, items: Items, weight: np.ndarray, cosine: float) -> DataFrame:
    """Windows that may reach ``cosine`` with some item: tid, terms, weights, stretch.

    ``tid`` is a hash of the text; ``stretch`` holds the window's words and half a window on
    either side, for the comparison that follows.
    """
    vocabulary = items.vocabulary
    part, need = shares(items.vectors(weight), cosine)
    unknown = len(vocabulary)
    part = np.hstack([part, np.zeros((len(part), 1))])  # for words outside the vocabulary
    by_word = [np.flatnonzero(x) for x in part.T]
    by_weight = [x[k] for x, k in zip(part.T, by_word)]
    widths = np.array([next((w for w in WIDTHS if w >= len(x)), len(x)) for x in items.words])

    def windows(at: np.ndarray) -> set[tuple[int, int]]:
        """Start and width of the windows that may reach an item; ``at`` numbers the words."""
        present = np.flatnonzero(np.bincount(at)).tolist()
        touched = np.concatenate([by_word[w] for w in present])
        weights = np.concatenate([by_weight[w] for w in present])
        held = np.bincount(touched, weights, minlength=len(need))
        found = set()
        for k in np.flatnonzero(held >= need):
            own, width = part[k][at], int(widths[k])
            total = np.concatenate(([0.0], np.cumsum(own)))
            starts = np.arange(0, len(at), width // 2)
            ends = np.minimum(starts + width, len(at))
            for a in starts[total[ends] - total[starts] >= need[k]].tolist():  # words may count twice here
                if part[k][np.unique(at[a:a + width])].sum() >= need[k]:
                    found.add((a, width))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, text in zip(batch["tid"].to_pylist(), batch["text"]):
                words = words_of(text.as_py())
                if not words:
                    continue
                at = np.fromiter(map(vocabulary.get, words, repeat(unknown)), np.int64, len(words))
                for start, width in sorted(windows(at)):
                    known = at[start:start + width]
                    terms, counts = np.unique(known[known < unknown], return_counts=True)
                    out.append({
                        "tid": tid, "terms": terms.tolist(), "weights": (counts * weight[terms]).tolist(),
                        "stretch": words[max(0, start - width // 2):start + width + width // 2],
                    })
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PASSAGE)

    return docs.select(F.xxhash64("text").alias("tid"), "text").mapInArrow(run, PASSAGE_DDL)


def _rows(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Dense rows of a batch's passages, some hundred at a time."""
    terms, weights = batch["terms"].to_pylist(), batch["weights"].to_pylist()
    for at in range(0, len(terms), 256):
        part = np.zeros((min(256, len(terms) - at), size))
        for k in range(len(part)):
            part[k, terms[at + k]] = weights[at + k]
        yield part


def _product(found: DataFrame, own: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis``, A being the items' rows ``own`` over the passages' rows."""
    size, rank = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank))
        for batch in batches:
            for part in _rows(batch, size):
                total += part.T @ (part @ basis)
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(list(total[held]), pa.list_(pa.float64()))], ["term", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, x in zip(batch[0].to_pylist(), batch[1]):
                row = x.values.to_numpy()
                total[term] = total[term] + row if term in total else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["term", "x"])

    shape = "term int, x array<double>"
    out = own.T @ (own @ basis)
    # A row for each word of the block at most, as long as the rank.
    for term, x in found.select("terms", "weights").mapInArrow(run, shape).repartition("term").mapInArrow(add, shape).collect():
        out[term] += np.array(x)
    return out


def latent_space(found: DataFrame, own: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors (words x rank) of items and passages, by a randomised SVD."""
    size = own.shape[1]
    rank = min(rank, size)
    basis = np.random.default_rng(seed).normal(size=(size, rank))
    for _ in range(2):
        basis = np.linalg.qr(_product(found, own, basis))[0]
    gram = basis.T @ _product(found, own, basis)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    held = values > 1e-9 * max(float(values[-1]), 1e-30)
    return basis @ vectors[:, held]


def common_subsequence(a: tuple[bytes, ...], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    places: dict[bytes, list[int]] = {}
    for k, word in enumerate(b):
        places.setdefault(word, []).append(k)
    ends: list[int] = []  # least end of a common subsequence of each length
    for word in a:
        for k in reversed(places.get(word, ())):
            at = bisect_left(ends, k)
            if at == len(ends):
                ends.append(k)
            else:
                ends[at] = k
    return len(ends)


_HIT = pa.schema([
    ("tid", pa.int64()), ("item", pa.int32()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer_found", pa.bool_()),
])
HIT = "tid long, item int, cosine double, overlap double, answer_found boolean"


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, overlap: float = 0.8, paraphrase: float = 0.5,
    rank: int = 256, block_items: int = 256, seed: int = 5,
) -> DataFrame:
    """tid (hash of a text), item_id, cosine, overlap, answer_found: the best hit of each text and item.

    Null and wordless texts and items are never hit. Equal texts are one text.
    """
    spark = docs.sparkSession
    columns = [c for c in ("item_id", "text", "answer") if c in benchmark.columns]
    n = benchmark.count()
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    hits = []
    for block in range(max(1, -(-n // block_items))):
        own_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-n // block_items)))) == block
        items = read_items([r.asDict() for r in benchmark.select(*columns).where(own_block).orderBy("item_id", "text").collect()])
        if items is not None:
            hits.append(_block_hits(docs, items, cosine, overlap, paraphrase, rank, seed, id_type))
    schema = f"tid long, item_id {id_type}, cosine double, overlap double, answer_found boolean"
    found = spark.createDataFrame([], schema)
    for part in hits:
        found = found.unionByName(part)
    return found


def _block_hits(docs: DataFrame, items: Items, cosine: float, overlap: float, paraphrase: float, rank: int, seed: int, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    weight = inverse_frequencies(docs, items.vocabulary)
    found = stage(passages(docs, items, weight, cosine), "passages")
    own = items.vectors(weight)
    space = latent_space(found, own, rank, seed)
    shared = spark.sparkContext.broadcast((space, _unit(own @ space)))  # bounded by the block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, latent = shared.value
        for batch in batches:
            out, at = [], 0
            tids, stretches = batch["tid"].to_pylist(), batch["stretch"].to_pylist()
            for part in _rows(batch, len(basis)):
                near = _unit(part @ basis) @ latent.T
                for k, item in zip(*np.nonzero(near >= cosine)):
                    words, answer, stretch = items.words[item], items.answers[item], stretches[at + k]
                    covered = common_subsequence(words, stretch) / len(words)
                    if covered >= paraphrase:
                        answered = common_subsequence(answer, stretch) >= 0.8 * len(answer)
                        if covered >= overlap or answered:
                            out.append((tids[at + k], int(item), float(near[k, item]), covered, answered))
                at += len(part)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_HIT.names, x)) for x in out], schema=_HIT)

    verified = found.mapInArrow(run, HIT).groupBy("tid", "item").agg(
        F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.bool_or("answer_found").alias("answer_found")
    )
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {id_type}")
    verified = stage(verified.join(names, "item").select("tid", "item_id", "cosine", "overlap", "answer_found"), "hits")
    drop_staged(found)
    return verified


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, overlap, answer_found for every row of ``docs`` and item found in it."""
    hits = contaminated_texts(docs, benchmark, **options)
    return docs.select("doc_id", F.xxhash64("text").alias("tid")).join(hits, "tid").drop("tid")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    own = unused(docs, "tid")
    hits = contaminated_texts(docs, benchmark, **options).select(F.col("tid").alias(own)).distinct()
    return docs.withColumn(own, F.xxhash64("text")).join(hits, own, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))
