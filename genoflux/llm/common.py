"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters of text that a task works on at once.
BATCH_ROWS, BATCH_CHARS = 1024, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir, which every executor sees; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Deletes what stash() wrote for df, which must not be read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Bytes that a side of a join may have to be broadcast, at 8 for each field.
BROADCAST = 16 << 20


def joinable(df: DataFrame) -> DataFrame:
    """A written-out table of numbers as a side of a join with whole documents: broadcast if its rows, which are counted, are few, so that
    the documents needn't be shuffled; hashed in each partition otherwise."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST else df.hint("shuffle_hash")


#: Tables that tasks fill and later tasks of the same Python worker use again.
_TABLES: list[dict] = []


def keep_table(own: dict | None = None) -> None:
    """Empties this worker's tables but for the task's own: a worker keeps those of one operator at a time."""
    for x in _TABLES:
        if x is not own:
            x.clear()
    if own is not None and not any(x is own for x in _TABLES):
        _TABLES.append(own)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, bounded in rows and in characters (but for a single longer text)."""
    for b in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_pylist()
        lo = total = 0
        for i, n in enumerate(sizes):
            if i > lo and (total + n > BATCH_CHARS or i - lo >= BATCH_ROWS):
                yield b.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        if lo < b.num_rows:
            yield b.slice(lo)
