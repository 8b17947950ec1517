"""Token ids of documents in compressed blocks with a shared zstandard dictionary.

The store is a folder of two Parquet tables, so that every file system Spark reaches will do:

``blocks``      one row per block of documents in ascending id order: ``part``, ``block`` (its
                place in the part), ``first_id``, ``last_id``, ``start`` (ids before it in its
                part), ``doc_ids``, ``offsets`` (of each frame in the payload), ``counts`` (ids
                of each document), ``payload`` (frames back to back), ``id_bytes`` (2 or 4, little
                endian), ``dictionary`` (sha256 of the dictionary the frames need)
``dictionary``  one row: ``sha256`` and ``content``

A frame is one document: its ids, compressed alone against the shared dictionary, so a short
document costs little and is read without its neighbours (:func:`read_documents`).

Encoding splits a text at ASCII white space, which this tokenizer's pattern never crosses, and
keeps the ids of the pieces seen so far; the tokenizer itself only sees new pieces. The
dictionary is trained on at most ``train_documents`` documents of least hashed id.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, scratch, stage, table

BLOCK_BYTES = 256 * 1024
CACHED_PIECES = 800_000
ENCODED = "doc_id long, n_tokens int, ids_crc32 long, frame binary"
BLOCKS = (
    "part int, block int, first_id long, last_id long, start long, doc_ids array<long>, offsets array<int>, "
    "counts array<int>, payload binary, id_bytes int, dictionary string"
)


#: Letters of one byte in Latin-1, then ASCII marks without the apostrophe: two pieces to the tokenizer's
#: pattern, untouched by its normal form.
PLAIN = re.compile("([a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}


class Encoder:
    """Text to serialized ids, remembering the pieces it has seen.

    A new piece of plain letters and marks goes to the tokenizer's model directly, word and marks
    apart, as its own pattern would split it; every other piece goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        steps = json.loads(tokenizer_json)
        kinds = [x["type"] for x in (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        names = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
        # The short way is right for this pipeline of steps alone.
        self.plain = kinds == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        largest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.id_bytes = 2 if largest < 1 << 16 else 4
        self.format = "H" if self.id_bytes == 2 else "I"
        self.end = self._pack([end_id])
        self.seen: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def _whole(self, piece: str) -> bytes:
        return self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = self._pack([x.id for x in self.model.tokenize(shown)])
        return ids

    def _marks(self, marks: str) -> bytes:
        ids = self.words.get(marks)
        if ids is None:
            ids = self.words[marks] = self._whole(marks)
        return ids

    def _new(self, piece: bytes) -> bytes:
        text = piece.decode()
        plain = PLAIN.fullmatch(text) if self.plain else None
        if not plain:
            return self._whole(text)
        word, marks = plain.groups()
        return self._word(word.lower()) + (self._marks(marks) if marks else b"")

    def __call__(self, text: str | None) -> bytes:
        if len(self.seen) > CACHED_PIECES:
            self.seen.clear()
        if len(self.words) > CACHED_PIECES:
            self.words.clear()
        pieces = (text or "").encode().split()
        found = list(map(self.seen.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    found[k] = self.seen.get(piece)
                    if found[k] is None:
                        found[k] = self.seen[piece] = self._new(piece)
        return b"".join(found) + self.end


@cache
def encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(tokenizer_json, end_id)


def _crc(ids: bytes, id_bytes: int) -> int:
    return zlib.crc32(np.frombuffer(ids, f"<u{id_bytes}").astype("<u4").tobytes())


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if not content:
        return None
    trained = content[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(
        content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    )


def train_dictionary(
    docs: DataFrame, tokenizer, end_id: int, train_documents: int = 2000, size: int = 64 * 1024, sample_bytes: int = 16 * 1024
) -> bytes:
    """A dictionary from at most ``train_documents`` documents and ``sample_bytes`` of each.

    Too few samples for training give a dictionary of the samples' own bytes, none an empty one.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_documents).distinct()
    # At most train_documents ids: a proven bound for the broadcast and for what is collected.
    sample = docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer.value, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([encode(t)[:sample_bytes] for t in batch[0].to_pylist()], pa.binary())})

    samples = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "x binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_store(
    docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 2, train_documents: int = 2000, level: int = 1
) -> str:
    """Encode every whole text of ``docs`` (doc_id, text) and write the store to ``path``.

    A null text is empty: its only id is the end id. Repeated rows are kept one by one, null ids
    come first. Other columns are ignored. Only compressed frames are shuffled, by range of id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, whatever the input
    content = train_dictionary(docs, tokenizer, end_id, train_documents)
    digest = hashlib.sha256(content).hexdigest()
    id_bytes = encoder(tokenizer_json, end_id).id_bytes

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer.value, end_id)
        shared = _dictionary(content)
        compress = (zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)).compress
        for batch in batches:
            counts, sums, frames = [], [], []
            for text in batch["text"]:
                ids = encode(text.as_py())
                counts.append(len(ids) // id_bytes)
                sums.append(_crc(ids, id_bytes))
                frames.append(compress(ids))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int32()), pa.array(sums, pa.int64()), pa.array(frames, pa.binary())],
                ["doc_id", "n_tokens", "ids_crc32", "frame"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start, rows
            ids, counts, frames = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            ends = np.cumsum([len(x) for x in frames])
            named = [x for x in ids if x is not None] or [None]
            row = {
                "part": part, "block": block, "first_id": named[0], "last_id": named[-1], "start": start, "doc_ids": ids,
                "offsets": [0, *ends.tolist()], "counts": counts, "payload": b"".join(frames), "id_bytes": id_bytes,
                "dictionary": digest,
            }
            block, start, rows = block + 1, start + sum(counts), []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        held = 0
        for batch in batches:
            for row in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["frame"].to_pylist()):
                rows.append(row)
                held += len(row[2])
                if held >= BLOCK_BYTES:
                    yield close()
                    held = 0
        if rows:
            yield close()

    # Staged, as sampling for the ranges would otherwise encode every text a second time.
    encoded = stage(docs.mapInArrow(encode_all, ENCODED), "frames")
    order = ["doc_id", "ids_crc32", "n_tokens"]
    ranged = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")
    drop_staged(encoded)
    spark.createDataFrame([(digest, bytearray(content))], "sha256 string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
    ("payload", pa.binary()), ("id_bytes", pa.int32()), ("dictionary", pa.string()),
])


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str]:
    digest, content = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(content)
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError("the store's dictionary doesn't match its hash")
    return spark.read.parquet(f"{path}/blocks"), content, digest


def _reader(content: bytes, digest: str):
    shared = _dictionary(content)
    decompress = (zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()).decompress

    def frames(row: dict) -> Iterator[tuple[int | None, bytes]]:
        if row["dictionary"] != digest:
            raise ValueError("a block was written with another dictionary")
        view, at = memoryview(row["payload"]), row["offsets"]
        for k, doc in enumerate(row["doc_ids"]):
            yield doc, decompress(view[at[k]:at[k + 1]])

    return frames


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    blocks, content, digest = _opened(spark, path)
    # One row per part, as many as tasks wrote: small enough for one window and a broadcast.
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _reader(content, digest)
        for batch in batches:
            for row in batch.to_pylist():
                at, width = row["start"], row["id_bytes"]
                docs, starts, counts, sums = [], [], [], []
                for doc, ids in frames(row):
                    docs.append(doc)
                    starts.append(at)
                    counts.append(len(ids) // width)
                    sums.append(_crc(ids, width))
                    at += counts[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (docs, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    wanted = placed.select("start", "doc_ids", "offsets", "payload", "id_bytes", "dictionary")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """doc_id and token ids of the given documents; only blocks that may hold one are read."""
    blocks, content, digest = _opened(spark, path)
    wanted = frozenset(ids)
    near = F.lit(False)
    for x in wanted:
        near = near | ((F.col("first_id") <= x) & (F.col("last_id") >= x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _reader(content, digest)
        for batch in batches:
            for row in batch.to_pylist():
                keep = [k for k, doc in enumerate(row["doc_ids"]) if doc in wanted]
                for k in keep:
                    at = row["offsets"]
                    one = {**row, "doc_ids": [row["doc_ids"][k]], "payload": row["payload"][at[k]:at[k + 1]], "offsets": [0, at[k + 1] - at[k]]}
                    for doc, data in frames(one):
                        found = np.frombuffer(data, f"<u{row['id_bytes']}").tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return blocks.where(near).mapInArrow(run, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer_json = file.read()
    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_json)
    return read_digests(spark, path)
