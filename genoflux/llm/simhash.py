"""Operator 4: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, by majority over the hashes of a text's word shingles.  For a radius of r every bit position has a
non-zero vector of r + 1 bits; table v, of 2 ** (r + 1) - 1, keeps the positions whose vector has an odd product with v.  Up to
r differing positions span at most r of the r + 1 dimensions, so some v is orthogonal to all of them, and the two
fingerprints are equal in that table: every pair within the radius collides.  A table keeps about half of the bits.

Documents with the same fingerprint are one class from the start, so only distinct fingerprints are compared.  Buckets of
up to ``MOST`` fingerprints are compared within one task by blocks of numpy operations.  Larger ones are dealt again, by r + 1
stretches of the positions that the table ignores, of which a pair within the radius must share one; what is then still too
large is cut into blocks and each pair of blocks is a group of its own.  Each group returns a spanning forest of
its links, not all pairs, which keeps every component whole.

``representatives`` finds near-duplicates by words, at a similarity of 0.8 or more over five-word shingles: the components of their
SimHash fingerprints are its first candidates, ``near_copies`` adds pairs that differ in more bits, and counts every link.

Defined cases: texts without a word (null, empty) have fingerprint zero and link like any other; fewer words than a shingle
are one shingle; repeated rows have one class; a null doc_id takes part, and is a component's id only if all its
members' are null; an empty table gives no row.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import joinable, partitions, slices, stash, table, unused
from .components import components

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Distinct fingerprints that one task compares with each other.
MOST = 8192
#: Links that a task gathers before it passes them on.
LINKS = 100_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks."""
    vectors = range(1, 2 ** (radius + 1))
    own = [vectors[i % len(vectors)] for i in range(64)] if len(vectors) <= 64 else random.Random(9).sample(vectors, 64)
    odd = lambda x: x.bit_count() & 1
    return [sum(1 << i for i in range(64) if odd(v & own[i])) for v in vectors]


def stretches(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks of stretches of the positions that a table ignores; as many differing positions as the radius leave one equal."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in rest[k :: radius + 1]) for k in range(radius + 1)]


def majority(hashes: Iterable[int], n: int) -> int:
    """The fingerprint of n hashes; each bit is set if it is in over half of them."""
    hashes, total = iter(hashes), np.zeros(64, np.int64)
    while len(h := np.fromiter(islice(hashes, 1 << 16), np.uint64)):  # long texts by parts
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def shingled(words: list[bytes], shingle: int) -> tuple[Iterator[int], int]:
    """Hashes of all shingles of words, and their number; fewer words than a shingle are one, and no word gives none."""
    n = max(1, len(words) - shingle + 1) if words else 0
    joined = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)][:n])
    return (xxhash.xxh64_intdigest(x, SEED) for x in joined), n


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of a whole text, as an unsigned number."""
    return majority(*shingled(_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id bigint, fp bigint")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of bits in which 64-bit fingerprints differ; of signed numbers numpy would count the bits of the absolute value."""
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64))


def forest(x: np.ndarray, y: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links, as row numbers, that connect what links within radius connect: among fingerprints x, or between x and y, whose rows follow.

    A row that is reached is never compared again with those reached before, so a dense group costs little more than its size."""
    rows, side = (x, None) if y is None else (np.concatenate((x, y)), np.arange(len(x) + len(y)) < len(x))
    left, out = np.arange(len(rows)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            near = differing(rows[now, None], rows[None, left]) <= radius
            if side is not None:
                near &= side[now, None] != side[None, left]
            if len(hit := np.flatnonzero(near.any(axis=0))):
                out += zip(now[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist())
                front, left = np.concatenate((front, left[hit])), np.delete(left, hit)
    return out


def _compare(buckets: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Links among rows (key, side, fp) that share a key: within side 0, or from side 0 to side 1 if there is a side 1."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # groups of two, by far the most, all at once
            (at, xs), (bt, ys) = ((b.column(n).offsets.to_numpy(), b.column(n).values.to_numpy()) for n in "xy")
            counts, others = np.diff(at), np.diff(bt)
            first = at[:-1][(counts == 2) & (others == 0)]
            first = first[differing(xs[first], xs[first + 1]) <= radius]
            held, size = [np.stack((xs[first], xs[first + 1]), axis=1)], 0
            for g in np.flatnonzero((counts > 2) | (others > 0)):
                x, y = xs[at[g] : at[g + 1]], ys[bt[g] : bt[g + 1]]
                held.append(np.concatenate((x, y))[np.array(forest(x, y if len(y) else None, radius), np.int64).reshape(-1, 2)])
                size += len(held[-1])
                if size > LINKS:
                    yield batch(held)
                    held, size = [], 0
            yield batch(held)

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("fp")))
    groups = buckets.groupBy(*key).agg(side(0).alias("x"), side(1).alias("y")).where(F.size("x") + F.size("y") > 1)
    return groups.select("x", "y").mapInArrow(task, "a bigint, b bigint")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct rows (fp) whose components are those of all pairs within the radius."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")
    all_masks = masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(signed(m)).alias("kept")) for t, m in enumerate(all_masks)]))
    # each row becomes one for each table, so rows are spread first
    spread = distinct.repartition(2 * partitions(distinct.sparkSession), "fp")
    dealt = spread.select("fp", tables.alias("k")).select("fp", "k.t", "k.kept")
    # written out, so that the join has an exchange on either side and Spark can split a large bucket
    sizes = stash(dealt.groupBy("t", "kept").agg(F.count("*").alias("n")).where(F.col("n") > 1), "sizes")
    shared = stash(dealt.join(sizes, ["t", "kept"]), "buckets")
    found = _compare(shared.where(F.col("n") <= most).withColumn("side", F.lit(0)), ["t", "kept"], radius)

    # buckets that are too large for a task
    parts = F.element_at(F.array(*[F.array(*[signed(x) for x in stretches(m, radius)]) for m in all_masks]), F.col("t") + 1)
    again = shared.where(F.col("n") > most).select("fp", "t", "kept", F.posexplode(parts).alias("s", "stretch"))
    again = again.withColumn("part", F.col("fp").bitwiseAND(F.col("stretch"))).drop("stretch")
    key = ["t", "kept", "s", "part"]
    counted = again.join(again.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > 1), key)
    # each row of a group of B blocks goes to the B pairs of blocks that hold its own
    own = counted.withColumn("blocks", F.ceil(F.col("m") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(*key, "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return found.union(_compare(own, [*key, "i", "j"], radius))


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id that is reachable over links, of documents."""
    fps = stash(fingerprints(docs, shingle), "fingerprints")
    distinct = stash(fps.select("fp").distinct(), "distinct")
    roots = components(links(distinct, radius, most)).withColumnRenamed("id", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # their smallest doc_ids come from two aggregates, whatever a component's size
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp")
    member = named.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, most: int = near_copies.MOST, weight: int = near_copies.WEIGHT) -> DataFrame:
    """documents without near-duplicates: of each component the row with the smallest doc_id stays, null ids first.

    Of rows that are the same in doc_id and text, one stays."""
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")]
    texts = docs.select(*key, F.col("text").cast("string").alias("text"))
    fps = stash(near_copies.fingerprints(texts, majority), "fingerprints")
    distinct = stash(fps.where(F.col("size") > 0).select(F.col("sim").alias("fp")).distinct(), "distinct")
    alike = components(links(distinct))
    roots = components(near_copies.links(texts, fps, alike, most, weight)).select("id.*", "component")
    roots = roots.unionByName(roots.select("component.*", "component").distinct())
    # rows of sets that have a component or another row
    sets = fps.groupBy("fp", "second").agg(F.count("*").alias("n")).join(roots, ["fp", "second"], "left")
    sets = stash(sets.where((F.col("n") > 1) | F.col("component").isNotNull()).withColumn("component", F.coalesce("component", F.struct("fp", "second"))).drop("n"), "sets")
    rows = stash(fps.select("doc", "text_hash", "fp", "second").join(sets, ["fp", "second"]).select("doc", "text_hash", "component"), "rows")
    # written out, so that the join has an exchange on either side and Spark can split a large component
    first = stash(rows.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("first")), "first")
    marked = rows.join(first, "component").groupBy("doc", "text_hash", (F.struct("doc", "text_hash") == F.col("first")).alias("stays")).agg(F.count("*").alias("n"))
    marked = stash(marked.where(~F.col("stays") | (F.col("n") > 1)).drop("n"), "marked")
    own = [unused(docs, x) for x in ("doc", "hash", "stays")]
    told = docs.withColumns(dict(zip(own, key))).join(joinable(marked.toDF(*own)), own[:2], "left")
    # a row that stays may occur more than once; only those need a comparison
    once, more = told.where(F.col(own[2]).isNull()), told.where(F.col(own[2]))
    return once.unionByName(more.dropDuplicates(own[:2])).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
