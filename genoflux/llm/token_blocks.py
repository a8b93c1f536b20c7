"""Operator 1: token ids in patched frame-of-reference blocks.

Documents are put in ascending doc_id order by a range shuffle (ties by the hash of the text, null ids
first), encoded, and written as segments.  A segment is a self-contained binary file body:

    header      "PFR1", then unsigned 32-bit: block length, documents, ids, blocks
    documents   a byte each: 1 if doc_id is known; 64-bit doc_id; unsigned 32-bit number of ids
    index       unsigned 32-bit start of each block, relative to the data, and the end of the last
    data        blocks: minimum (u32), width (u8), exceptions (u16), packed differences (block length x width
                bits, low bit first), exception places (u16), exception differences (u32)

The width of a block is what ``percentile`` of its differences from the minimum fit in; larger ones go to
the exception list.  Segments are rows of a Parquet table (shard, segment, shard_start, n_tokens, payload), so
Spark's own commit protocol writes and reads them on any file system, and a retried task leaves no trace.

Defined cases: a null or empty text gives only the end id; repeated rows are written as often as they occur; an
empty table gives no segment.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder, slices, table
from .tokens import encoder

BLOCK = 1024
SEGMENT_IDS = 1 << 20
#: Share of a block's differences that its width has to hold.
PERCENTILE = 98.0
WRITTEN = "shard int, segment int, shard_start bigint, n_docs bigint, n_tokens bigint, payload binary"


def _places(w: int) -> list[tuple[int, int, int]]:
    """Of each of 32 values of w bits: its place, the 32-bit word that it starts in, and its first bit there."""
    return [(k, k * w // 32, k * w % 32) for k in range(32)]


def _pack_rows(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2 ** w as w bits each, low bit first."""
    v = v.reshape(-1, 32)
    out = np.zeros((len(v), max(w, 1)), "<u4")
    for k, word, bit in _places(w) if w else ():
        out[:, word] |= v[:, k] << np.uint32(bit)
        if bit + w > 32:
            out[:, word + 1] |= v[:, k] >> np.uint32(32 - bit)
    return out[:, :w]


def _unpack_rows(body: np.ndarray, w: int) -> np.ndarray:
    words, mask = body.reshape(-1, w), np.uint32((1 << w) - 1)
    out = np.empty((len(words), 32), "<u4")
    for k, word, bit in _places(w):
        x = words[:, word] >> np.uint32(bit)
        if bit + w > 32:
            x |= words[:, word + 1] << np.uint32(32 - bit)
        out[:, k] = x & mask
    return out


def pack(ids: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The data of a segment and its index."""
    if not len(ids):
        return b"", np.zeros(1, "<u4")
    n_blocks = -(-len(ids) // block)
    v = np.full(n_blocks * block, ids[-1], "<u4")
    v[: len(ids)] = ids
    v = v.reshape(n_blocks, block)
    low = v.min(axis=1)
    diff = v - low[:, None]
    # the least width that enough differences fit in
    width, wanted = np.full(n_blocks, int(diff.max()).bit_length(), np.uint8), block * percentile / 100
    for w in range(int(width[0]) - 1, -1, -1):
        fits = np.count_nonzero(diff < np.uint32(1 << w), axis=1) >= wanted
        width[fits] = w
        if not fits.any():
            break
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        inside = diff[rows] & np.uint32((1 << int(w)) - 1)
        for i, body in zip(rows, _pack_rows(inside, int(w)).reshape(len(rows), -1)):
            packed[i] = body.tobytes()
    past = (diff >> np.minimum(width, 31)[:, None]) * (width < 32)[:, None]
    many = np.count_nonzero(past, axis=1)
    out, starts, end = [], [0], 0
    for i in range(n_blocks):
        over = np.flatnonzero(past[i]) if many[i] else np.empty(0, int)
        body = b"".join((low[i].tobytes(), width[i].tobytes(), np.uint16(len(over)).tobytes(), packed[i], over.astype("<u2").tobytes(), diff[i][over].tobytes()))
        out.append(body)
        starts.append(end := end + len(body))
    return b"".join(out), np.asarray(starts, "<u4")


def unpack(data: bytes, starts: np.ndarray, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids of the blocks first to last; the index makes any block readable alone."""
    last = len(starts) - 1 if last is None else last
    out = np.empty((last - first, block), "<u4")
    by_width: dict[int, list[int]] = {}
    for i in range(first, last):
        by_width.setdefault(data[starts[i] + 4], []).append(i)
    for w, rows in by_width.items():
        size = block * w // 8
        body = np.frombuffer(b"".join(data[starts[i] + 7 : starts[i] + 7 + size] for i in rows), "<u4")
        out[np.asarray(rows) - first] = _unpack_rows(body, w).reshape(len(rows), block) if w else 0
    for i in range(first, last):
        at, w = int(starts[i]), data[starts[i] + 4]
        low, k = np.frombuffer(data, "<u4", 1, at)[0], int(np.frombuffer(data, "<u2", 1, at + 5)[0])
        if k:
            at += 7 + block * w // 8
            out[i - first, np.frombuffer(data, "<u2", k, at)] = np.frombuffer(data, "<u4", k, at + 2 * k)
        out[i - first] += low
    return out.reshape(-1)[: n - first * block]


def segment(doc_ids: list[int | None], ids: list[bytes], percentile: float) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    data, starts = pack(flat, percentile)
    known = np.asarray([x is not None for x in doc_ids], np.uint8)
    head = np.asarray([BLOCK, len(ids), len(flat), len(starts) - 1], "<u4")
    return b"".join((b"PFR1", head.tobytes(), known.tobytes(), np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), np.asarray([len(x) // 4 for x in ids], "<u4").tobytes(), starts.tobytes(), data))


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a segment of token blocks")
    block, n_docs, n, n_blocks = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
    at = 20
    known = np.frombuffer(payload, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at := at + n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs)
    starts = np.frombuffer(payload, "<u4", n_blocks + 1, at := at + 4 * n_docs)
    ids = unpack(payload[at + 4 * (n_blocks + 1) :], starts, n, block)
    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, ids


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, percentile: float = PERCENTILE) -> None:
    """Encodes documents (doc_id, text) and writes their segments below path."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, end = encoder(tokenizer), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        held_ids: list[int | None] = []
        held: list[bytes] = []
        size = start = k = 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held, size, start, k
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([segment(held_ids, held, percentile)], pa.binary())], names=["shard", "segment", "shard_start", "n_docs", "n_tokens", "payload"])
            held_ids, held, size, start, k = [], [], 0, start + size, k + 1
            return row

        for b in slices(batches):
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                held_ids.append(d)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(task, WRITTEN).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the segments below path: doc_id, start, n_tokens, ids_crc32 (and ids)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, payload in zip(*(b.column(x).to_pylist() for x in ("shard", "shard_start", "payload"))):
                doc_ids, lengths, ids = read_segment(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts, raw = ends - lengths, ids.tobytes()
                cols = [pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(start + starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts, ends)], pa.int64())]
                names = ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.parquet(path)
    # a row for each shard, of which there are as many as shuffle partitions
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.select("shard", "shard_start", "payload").mapInArrow(task, "shard int, doc_id bigint, in_shard bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    return rows.join(before, "shard").select("doc_id", (F.col("in_shard") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-blocks")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
