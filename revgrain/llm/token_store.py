"""Token files: one zstandard frame a document with a shared dictionary, and an offset index for short-document access.

Layout, a Parquet table in a shared folder, one row a block: ``shard``, ``block``, ``dictionary`` (SHA-256 of the dictionary
all frames need), ``payload`` (the frames of consecutive documents in a row) and ``entries`` (id, offset and size of each
frame, its token count and the tokens of the shard before it). Reading one document opens the columns without payloads,
then one block, and unpacks one frame. The dictionary, fitted on a bounded sample of serialised id arrays, is a table of
one row beside the blocks. Ids are little-endian unsigned integers, of 16 bits if the vocabulary allows.

Shards are ranges of the document id in ascending order; their bounds come from a sketch of the id column, so the texts are
encoded once and only the frames are shuffled.

Defined cases: a null text counts as empty (a frame with the end id alone); null ids come first; repeated rows get a frame
each; an empty table gives no block; a text of any length is one frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import scratch_path, sliced
from revgrain.llm.tokens import as_ids, encoded

#: The dictionary is fitted on so many documents at most, of each a run of so many ids at most.
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 2_048, 65_536
#: Frames of a block together, in bytes, unless one alone is larger; documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 1 << 18, 2_048
FRAMES = "id long, shard int, n_tokens int, frame binary"
BLOCKS = "shard int, block int, dictionary string, payload binary, entries array<struct<id:long,offset:long,size:int,n_tokens:int,before:long>>"


def packed(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def fit_dictionary(docs: DataFrame, path: str, words: bool, end: int, wide: bool, id_col: str, text_col: str, rows: int) -> bytes:
    """A zstandard dictionary for id arrays; empty if there is too little to fit one on."""
    share = min(1.0, SAMPLE / max(rows, 1))
    some = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(text_col)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            arrays = [as_ids(raw) for raw in encoded(path, words, batch.column(0), end)]
            runs = [a[(k := int(a[: 4].sum()) % max(1, len(a) - SAMPLE_IDS)):k + SAMPLE_IDS] for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([packed(r, wide) for r in runs], pa.binary())], names=["ids"])

    samples = [r.ids for r in some.mapInArrow(serialise, "ids binary").limit(2 * SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(s) for s in samples]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(
    docs: DataFrame, folder: str | None = None, *, path: str, words: bool, end: int, wide: bool = False, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Encode every text and write the files; returns their folder (``blocks`` and ``dictionary`` below it)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    rows = ids.count()
    data = fit_dictionary(docs, path, words, end, wide, id_col, text_col, rows)
    name = hashlib.sha256(data).hexdigest()
    spark.range(1).select(F.lit(name).alias("dictionary"), F.unhex(F.lit(data.hex())).alias("data")).write.parquet(f"{folder}/dictionary")
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(int(x) for x in ids.approxQuantile("id", [k / shards for k in range(1, shards)], 0.2 / shards))) if rows else []
    sent = spark.sparkContext.broadcast((data, np.array(bounds, dtype="<i8")))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bounds = sent.value
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for batch in sliced(batches):
            arrays = [as_ids(raw) for raw in encoded(path, words, batch.column(1), end)]
            shard = np.searchsorted(bounds, batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
            columns = [batch.column(0), pa.array(shard, pa.int32()), pa.array([len(a) for a in arrays], pa.int32()), pa.array([pack.compress(packed(a, wide)) for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shard", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, size, entries, parts = None, 0, 0, 0, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "dictionary": name, "payload": b"".join(parts), "entries": entries}], schema=BLOCK_SCHEMA)

        for batch in batches:
            for x in batch.to_pylist():
                if entries and (x["shard"] != shard or size + len(x["frame"]) > BLOCK_BYTES or len(entries) >= BLOCK_DOCS):
                    yield row()
                    block, size, entries, parts = block + 1, 0, [], []
                if x["shard"] != shard:
                    shard, block, before = x["shard"], 0, 0
                entries.append({"id": x["id"], "offset": size, "size": len(x["frame"]), "n_tokens": x["n_tokens"], "before": before})
                parts.append(x["frame"])
                size, before = size + len(x["frame"]), before + x["n_tokens"]
        if entries:
            yield row()

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(frames, FRAMES)
    ordered = made.repartition(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "frame")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


ENTRY = pa.struct([("id", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("n_tokens", pa.int32()), ("before", pa.int64())])
BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("payload", pa.binary()), ("entries", pa.list_(ENTRY))])


class Frames:
    """Unpacks frames; refuses a block written with another dictionary."""

    def __init__(self, data: bytes, wide: bool):
        self.name, self.kind = hashlib.sha256(data).hexdigest(), "<u4" if wide else "<u2"
        self.pack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)

    def ids(self, payload: bytes, offset: int, size: int, dictionary: str) -> np.ndarray:
        if dictionary != self.name:
            raise ValueError(f"block needs dictionary {dictionary}, not {self.name}")
        return np.frombuffer(self.pack.decompress(memoryview(payload)[offset:offset + size]), dtype=self.kind).astype("<u4")


def _dictionary(spark, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().data)


def read_documents(spark, folder: str, wanted: list[int], wide: bool = False) -> dict[int, np.ndarray]:
    """Ids of a few documents, by the index: blocks that hold none of them are left closed."""
    frames = Frames(_dictionary(spark, folder), wide)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    index = blocks.select("shard", "block", F.explode("entries").alias("e")).filter(F.col("e.id").isin(wanted))
    rows = index.join(blocks.select("shard", "block", "dictionary", "payload"), ["shard", "block"]).select("dictionary", "e.*", F.expr("substring(payload, e.offset + 1, e.size)").alias("frame"))
    return {r.id: frames.ids(bytes(r.frame), 0, r.size, r.dictionary) for r in rows.collect()}


def read_all(spark, folder: str, wide: bool = False) -> DataFrame:
    """Every document read back: (id, start, n_tokens, ids_crc32), ``start`` counting the ids of all documents before it."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sent = spark.sparkContext.broadcast(_dictionary(spark, folder))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(sent.value, wide)
        for batch in batches:
            for x in batch.to_pylist():
                ids = [frames.ids(x["payload"], e["offset"], e["size"], x["dictionary"]) for e in x["entries"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["shard"]] * len(ids), pa.int32()), pa.array([e["id"] for e in x["entries"]], pa.int64()), pa.array([e["before"] for e in x["entries"]], pa.int64()),
                    pa.array([len(a) for a in ids], pa.int64()), pa.array([crc32(a.tobytes()) for a in ids], pa.int64()),
                ], names=["shard", "id", "before", "n_tokens", "ids_crc32"])

    read = blocks.select("shard", "dictionary", "payload", "entries").mapInArrow(unpack, "shard int, id long, before long, n_tokens long, ids_crc32 long")
    # One row a shard, and there are a few shards for each core.
    sums = blocks.select("shard", F.explode("entries").alias("e")).groupBy("shard").agg(F.sum("e.n_tokens").alias("n"))
    first = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    return read.join(F.broadcast(first), "shard").select("id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
