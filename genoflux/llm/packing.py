"""Operator 6: bounded-space online best-fit packing of documents into token sequences.

Each task encodes its documents and packs their pieces as they come: a piece goes to the open sequence that it fills
best, found as the lowest set bit of a bitset keyed by free space.  At most ``open_bins`` sequences are open; when
another is needed, the fullest closes first.  Pieces in sequences that are still open when a task ends are packed once
more in the same way, in a 32nd of the tasks, so that partly filled sequences remain for few tasks only.  There they come
in runs of about ``RUN`` pieces, longest first within a run: what one run leaves open, the short pieces of the next ones fill.

Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids; the last may be shorter.
Defined cases: a null or empty text gives one piece, the end id; repeated rows are packed as often as they occur, each
with its own pieces; an empty table gives no row.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, table
from .tokens import encoder

FIELDS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, settled boolean"
#: Sequences of a task have ids from its number times this; those of the second round have negative ones.
IDS_OF_TASK = 1 << 32
#: Pieces that are sorted together in the second round.
RUN = 1024


class Bins:
    """Open sequences by free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: a sequence with f ids of space is open
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.count = self.made = 0

    def add(self, length: int, item: object) -> list | None:
        """Puts an item in; returns [space, number, (item, offset)...] of a sequence that closes."""
        shut = None
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if self.count == self.most:
                shut = self._take((self.free & -self.free).bit_length() - 1)
            b, space = [self.capacity, self.made], self.capacity
            self.made += 1
        b.append((item, self.capacity - space))
        b[0] = space - length
        if not b[0]:  # full; none else closes then, unless this one was new
            if shut is None:
                return b
            self._put(shut)
            return b
        self._put(b)
        return shut

    def _take(self, space: int) -> list:
        b = self.open[space].pop()
        if not self.open[space]:
            self.free ^= 1 << space
        self.count -= 1
        return b

    def _put(self, b: list) -> None:
        self.open[b[0]].append(b)
        self.free |= 1 << b[0]
        self.count += 1

    def rest(self) -> Iterator[list]:
        return (b for bins in self.open for b in bins)


def _rows(seqs: list[list], base: int, settled: bool, with_ids: bool) -> pa.RecordBatch:
    flat = [(*item, base + b[1], at) for b in seqs for item, at in b[2:]]
    cols = list(zip(*flat)) if flat else [[] for _ in range(8)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    arrays = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
    arrays["settled"] = pa.array([settled] * len(flat), pa.bool_())
    keep = [*names[:5], "sequence_id", "offset", "settled", *["ids"] * with_ids]
    return pa.RecordBatch.from_arrays([arrays[n] for n in keep], names=keep)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, open_bins: int = 512, with_ids: bool = False) -> DataFrame:
    """A row for each piece of documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids)."""
    spark = docs.sparkSession
    fields = FIELDS + ", ids array<bigint>" * with_ids

    def pieces(ids: bytes, doc_id: int | None) -> Iterator[tuple]:
        for k, at in enumerate(range(0, len(ids) // 4, capacity)):
            part = ids[4 * at : 4 * (at + capacity)]
            yield doc_id, k, at, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if with_ids else None

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins, end, base = encoder(tokenizer), Bins(capacity, open_bins), np.uint32(end_id).tobytes(), TaskContext.get().partitionId() * IDS_OF_TASK
        for b in slices(batches):
            shut = [bins.add(p[3], p) for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())) for p in pieces(ids + end, d)]
            yield _rows([x for x in shut if x], base, True, with_ids)
        yield _rows(list(bins.rest()), base, False, with_ids)

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), -(TaskContext.get().partitionId() + 1) * IDS_OF_TASK
        for b in batches:
            shut = [bins.add(p[3], p) for p in zip(*(b.column(n).to_pylist() for n in ("doc_id", "piece", "start", "length", "ids_crc32")), b.column("ids").to_pylist() if with_ids else [None] * b.num_rows)]
            yield _rows([x for x in shut if x], base, True, with_ids)
        yield _rows(list(bins.rest()), base, True, with_ids)

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = stash(read.mapInArrow(first, fields), "packed")
    tasks = max(1, read.rdd.getNumPartitions() // 32)
    left = placed.where(~F.col("settled"))
    runs = max(1, left.count() // RUN)
    left = left.withColumn("run", F.pmod(F.xxhash64("doc_id", "piece", "sequence_id", "offset"), F.lit(runs))).repartition(tasks, "run")
    left = left.sortWithinPartitions("run", F.desc("length"), "doc_id", "piece", "sequence_id", "offset").drop("run").mapInArrow(second, fields)
    return placed.where("settled").unionByName(left).drop("settled")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
