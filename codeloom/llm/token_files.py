"""Token files: patched frame-of-reference blocks in ascending document order.

A file is a sequence of segments, each a row of a Parquet container whose one
``payload`` column holds our bytes, so that any store that Spark writes will do:

    magic 'TFOR', uint32 version, uint64 number of ids, uint32 block size, uint32 number of documents
    int64 document ids, a byte for each that is 1 where the id is null, uint64 cumulated ends of the documents (in ids)
    uint64 starts of the blocks (byte offsets in the body) and the body's end
    body: per block uint32 minimum, uint8 width, uint16 number of exceptions,
          packed values of that width, uint16 exception places, uint32 exception values

A block's minimum is subtracted; the width is what a percentile of its values
needs; larger ones are exceptions. ``read_ids`` opens only the blocks it needs.

Texts that are null count as empty (only the end id is written). Null document
ids come first, as in Spark's ascending order, and are kept as null. Repeated
document ids are written one after another, in an order fixed by the text's hash.
An empty table gives no segment. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._util import rows_of, shared_path, tidy, width
from codeloom.llm.tokens import encoder

MAGIC, VERSION, BLOCK = b"TFOR", 2, 1024
HEAD = struct.Struct("<4sIQII")
BLOCK_HEAD = struct.Struct("<IBH")


def _pack_bits(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    planes = ((values[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def _unpack_bits(raw: memoryview, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, dtype=np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), dtype=np.uint8)
    padded[:, :bits] = planes
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def pack_block(ids: np.ndarray, percentile: float) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    k = min(len(rest) - 1, int(len(rest) * percentile))
    bits = int(np.partition(rest, k)[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(bits)) if bits < 32 else np.zeros(0, dtype=np.int64)
    kept = rest.copy()
    kept[odd] = 0
    return BLOCK_HEAD.pack(low, bits, len(odd)) + _pack_bits(kept, bits) + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(raw: memoryview, n: int) -> np.ndarray:
    low, bits, k = BLOCK_HEAD.unpack_from(raw)
    at = BLOCK_HEAD.size
    size = (n * bits + 7) // 8
    out = _unpack_bits(raw[at : at + size], n, bits)
    at += size
    places = np.frombuffer(raw, dtype="<u2", count=k, offset=at)
    out[places] = np.frombuffer(raw, dtype="<u4", count=k, offset=at + 2 * k)
    return out + np.uint32(low)


def pack_segment(doc_ids: list[int | None], ids: list[bytes], percentile: float = 0.9, block: int = BLOCK) -> bytes:
    """The bytes of one segment; ``ids`` are little-endian unsigned 32-bit."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    bodies = [pack_block(flat[i : i + block], percentile) for i in range(0, len(flat), block)]
    starts = np.cumsum([0] + [len(b) for b in bodies], dtype=np.uint64)
    return b"".join([HEAD.pack(MAGIC, VERSION, len(flat), block, len(doc_ids)), np.array([k or 0 for k in doc_ids], dtype="<i8").tobytes(), bytes(k is None for k in doc_ids), ends.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), *bodies])


class Segment:
    """Reads a segment; any range of ids costs only its blocks."""

    def __init__(self, payload: bytes):
        magic, version, self.n, self.block, docs = HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, dtype="<i8", count=docs, offset=at)
        self.no_id = np.frombuffer(payload, dtype="?", count=docs, offset=at + 8 * docs)
        self.ends = np.frombuffer(payload, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
        at += 17 * docs
        blocks = -(-self.n // self.block)
        self.starts = np.frombuffer(payload, dtype="<u8", count=blocks + 1, offset=at).astype(np.int64)
        self.body = memoryview(payload)[at + 8 * (blocks + 1) :]

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_block(self.body[self.starts[b] : self.starts[b + 1]], min(self.block, self.n - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", percentile: float = 0.9, segment_ids: int = 1 << 20) -> None:
    """Encodes each text, appends ``end_id`` and writes segments to ``path``: rows
    (file_no, segment, n_ids, payload), ascending by (file_no, segment) = by document id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep_caches=True)
        enc, end = encoder(vocabulary), struct.pack("<I", end_id)
        file_no, segment = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_segment(keys, held, percentile)], pa.binary())], names=["file_no", "segment", "n_ids", "payload"])

        for batch in batches:
            for some, texts in rows_of(batch, 1 << 20):
                for key, found in zip(some, enc.encode_all(texts), strict=True):
                    ids = found + end
                    if held and size + len(ids) // 4 > segment_ids:
                        yield flush()
                        segment, keys, held, size = segment + 1, [], [], 0
                    keys.append(key)
                    held.append(ids)
                    size += len(ids) // 4
        if held:
            yield flush()

    rows = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text")
    ranged = rows.repartitionByRange(width(df.sparkSession), F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ranged.mapInArrow(run, "file_no int, segment int, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files: ``start`` counts all
    ids before the document. The manifest (one number for each segment, not for each
    document) goes through a running sum over files on the cluster."""
    from pyspark.sql import Window

    files = spark.read.parquet(path)
    sizes = files.select("file_no", "segment", "n_ids")
    per_file = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before_file = per_file.withColumn("before", F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))).select("file_no", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("file_no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before_file, "file_no").select("file_no", "segment", (F.col("inside") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.column(2)[i].as_py())
                begins = np.r_[0, seg.ends[:-1]].astype(np.int64)
                crcs = []
                step = 1 << 18
                buffer, low, high = np.zeros(0, dtype="<u4"), 0, 0
                for b, e in zip(begins, seg.ends, strict=True):
                    if e > high:  # a stretch of documents at a time
                        low, high = int(b), int(min(seg.n, max(e, b + step)))
                        buffer = seg.read_ids(low, high).astype("<u4")
                    crcs.append(zlib.crc32(buffer[b - low : e - low].tobytes()))
                key = pa.array(seg.doc_ids, pa.int64(), mask=seg.no_id)
                same = np.ones(len(begins), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(same * batch.column(0)[i].as_py()), pa.array(same * batch.column(1)[i].as_py()), key, pa.array(begins), pa.array(seg.ends - begins), pa.array(crcs, pa.int64())], names=["file_no", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("file_no", "segment", "payload").mapInArrow(run, "file_no int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["file_no", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(df: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files (to the shared folder if ``path`` is None) and reads them back."""
    spark = df.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(df, path, vocabulary, end_id, id_col, text_col)
    return read_token_files(spark, path).withColumnRenamed("doc_id", id_col)
