"""Near-duplicates by words: links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are first the texts whose SimHash fingerprints, of the same shingles, hang together: operator 4 links them by its covering
masks, and each of its components is a key.  At 0.8 two SimHashes differ in 10 of 64 bits on average, which lies beyond its radius.
For those pairs there are ``BANDS`` more keys, each made of ``MINIMA`` minima of differently hashed shingles.  Two minima are equal with a
probability that is the similarity itself, whatever was added, cut off or changed, so of pairs at 0.8 one in 12,000 shares no key, and
fewer above.

Every link is then counted: candidates that hang together are a cluster, the shingles of a cluster's texts meet in one task, and
it returns a spanning forest of the pairs that reach 0.8.  In clusters of over ``MOST`` texts or ``WEIGHT`` shingles the texts of each
key meet instead; where these are too many as well, they are cut into blocks, and each pair of blocks meets.

Texts with the same set are one from the start.  A word is letters and digits in lower case; fewer than five are one shingle;
texts without a word are alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joinable, keep_table, partitions, slices, stash
from .components import components

BANDS, MINIMA, SHINGLE = 40, 7, 5
#: Texts and shingles that one task compares with each other.
MOST, WEIGHT = 2048, 1_000_000

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(11)
_XORS = _random.integers(0, 1 << 32, BANDS * MINIMA, np.uint32)
_FACTORS = _random.integers(0, 1 << 32, BANDS * MINIMA, np.uint32) | np.uint32(1)
_KEY = ["fp", "second"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = np.fromiter(map(xxhash.xxh64_intdigest, _WORD.findall((text or "").lower())), np.uint64)
    n = min(SHINGLE, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _BASE + words[k : k + len(h)]
    return np.unique(_mixed(h))


def name(own: np.ndarray) -> tuple[int, int]:
    """Of a set of shingles, in 128 bits; zero if it is empty."""
    high, low = divmod(xxhash.xxh3_128_intdigest(own.tobytes()), 1 << 64) if len(own) else (0, 0)
    return high, low


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles by its minima; none if it is empty."""
    if not len(own):
        return own
    least = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 256):
        np.minimum(least, ((short[k : k + 256, None] ^ _XORS) * _FACTORS).min(axis=0), out=least)
    h = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        h = h * _BASE + column
    return _mixed(h + np.arange(BANDS, dtype=np.uint64))  # no key belongs to two bands


def similar(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Whether sets of a and b elements with that many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def forest(values: np.ndarray, sizes: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links, as row numbers, that connect what similar pairs connect; rows are sets, one after the other in values.

    If there are two sides, only pairs across them count.  A row that is reached is never compared with those reached before."""
    if len(sizes) < 2:
        return []
    distinct, at = np.unique(values, return_inverse=True)
    ends = np.cumsum(sizes)
    mark, both = np.zeros(len(distinct), np.int32), side.min() != side.max()
    left, held, out, front = np.arange(len(sizes)), at, [], []
    while len(left):
        if not front:
            front = [int(left[0])]
            held, left = held[sizes[left[0]] :], left[1:]
            continue
        now = front.pop()
        own = at[ends[now] - sizes[now] : ends[now]]
        mark[own] = 1
        n = sizes[left]
        hit = similar(np.add.reduceat(mark[held], np.cumsum(n) - n), n, sizes[now])
        mark[own] = 0
        if both:
            hit &= side[left] != side[now]
        if hit.any():
            found = left[hit].tolist()
            out += [(now, x) for x in found]
            front += found
            held, left = held[np.repeat(~hit, n)], left[~hit]
    return out


def fingerprints(docs: DataFrame, simhash: Callable[[Iterable[int], int], int]) -> DataFrame:
    """doc, text_hash, the name (fp, second) of the set of shingles, its size, keys and simhash (of hashes and their number), of rows (doc, text_hash, text)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_table()
        for b in slices(batches):
            names, sizes, keys, sims = [], [], [], []
            for text in b.column("text").to_pylist():
                own = shingles(text)
                names.append(name(own))
                sizes.append(len(own))
                keys.append(band_keys(own).view(np.int64))
                sims.append(simhash(own.tolist(), len(own)))
            fp, second = (pa.array(np.array([x[i] for x in names], np.uint64).view(np.int64)) for i in (0, 1))
            sim = pa.array(np.array(sims, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text_hash"), fp, second, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), sim], names=["doc", "text_hash", *_KEY, "size", "keys", "sim"])

    return docs.mapInArrow(task, "doc bigint, text_hash bigint, fp bigint, second bigint, size bigint, keys array<bigint>, sim bigint")


def _shingled(texts: DataFrame) -> DataFrame:
    """Rows (fp, second, shingles) of rows (fp, second, text)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(x).view(np.int64) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("second"), pa.array(sets, pa.list_(pa.int64()))], names=[*_KEY, "shingles"])

    return texts.mapInArrow(task, "fp bigint, second bigint, shingles array<bigint>")


def _counted(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Links (a, b) among rows (unit, side, fp, second, shingles) of a unit, all of which lie in one task and follow each other."""

    def links(parts: list[tuple]) -> pa.RecordBatch:
        side, fp, second, sizes, values = (np.concatenate(x) for x in zip(*parts))
        found = np.array(forest(values, sizes, side), np.int64).reshape(-1, 2)
        node = lambda i: pa.StructArray.from_arrays([pa.array(fp[found[:, i]]), pa.array(second[found[:, i]])], names=_KEY)
        return pa.RecordBatch.from_arrays([node(0), node(1)], names=["a", "b"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            units = np.stack([b.column(x).to_numpy() for x in unit], axis=1)
            columns = [b.column(x).to_numpy() for x in ("side", *_KEY)]
            lists = b.column("shingles")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if parts and tuple(units[lo]) != last:
                    yield links(parts)
                    parts = []
                last = tuple(units[lo])
                # copies, as a batch's memory is used again
                parts.append((*(c[lo:hi].copy() for c in columns), np.diff(offsets[lo : hi + 1]).astype(np.int64), values[offsets[lo] : offsets[hi]].copy()))
        if parts:
            yield links(parts)

    dealt = rows.repartition(2 * partitions(rows.sparkSession), *unit).sortWithinPartitions(*unit, "side")
    return dealt.mapInArrow(task, "a struct<fp: bigint, second: bigint>, b struct<fp: bigint, second: bigint>")


def links(docs: DataFrame, fps: DataFrame, alike: DataFrame, most: int = MOST, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) between sets (fp, second) of fps, whose components are those of all similar candidates; docs are (doc, text_hash, text),
    alike are SimHash fingerprints (id) with their component, but for those that are alone or are a component's id."""
    first = F.min(F.struct("doc", "text_hash", "size", "keys", "sim")).alias("first")
    sets = stash(fps.where(F.col("size") > 0).groupBy(*_KEY).agg(first).select(*_KEY, "first.*"), "sets")
    near = sets.select(*_KEY, F.col("sim").alias("id")).join(alike, "id", "left").select(*_KEY, F.xxhash64(F.coalesce("component", "id")).alias("kept"))
    dealt = sets.select(*_KEY, F.explode("keys").alias("kept")).union(near)
    # written out, so that the join has an exchange on either side and Spark can split a large bucket
    several = stash(dealt.groupBy("kept").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("kept"), "several")
    shared = stash(dealt.join(several, "kept"), "buckets")
    pivots = stash(shared.groupBy("kept").agg(F.min(F.struct(*_KEY)).alias("pivot")), "pivots")
    found = components(shared.join(pivots, "kept").select(F.struct(*_KEY).alias("a"), F.col("pivot").alias("b")))
    found = stash(found.union(found.select(F.col("component").alias("id"), "component").distinct()).select("id.*", "component"), "candidates")
    member = sets.drop("keys", "sim").join(found, _KEY)
    counts = member.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    counts = stash(counts.select("component", ((F.col("n") > most) | (F.col("w") > weight)).alias("large")), "clusters")
    member = stash(member.join(counts, "component"), "members")

    unit = ["x", "y", "i", "j"]
    zero = F.lit(0).cast("bigint")
    small = member.where(~F.col("large")).select(F.col("component.fp").alias("x"), F.col("component.second").alias("y"), (zero - 1).alias("i"), zero.alias("j"), zero.alias("side"), *_KEY)
    # of large clusters, the texts of each key; those that several keys share alike meet once
    again = shared.join(member.where("large").select(*_KEY, "size"), _KEY)
    whole = again.groupBy("kept").agg(F.count("*").alias("m"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64(*_KEY)).alias("h"), F.bit_xor("fp").alias("g"))
    whole = whole.groupBy("m", "w", "h", "g").agg(F.min("kept").alias("kept"))
    blocks = F.ceil(F.greatest(F.col("m") / most, F.col("w") / weight)).cast("bigint")
    whole = stash(whole.select("kept", blocks.alias("blocks")), "wholes")
    # each row of B blocks goes to the B pairs of blocks that hold its own
    own = again.join(whole, "kept").withColumn("own", F.pmod(F.xxhash64(*_KEY), F.col("blocks")))
    own = own.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    large = own.select(F.col("kept").alias("x"), zero.alias("y"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("bigint").alias("side"), *_KEY)

    texts = docs.join(joinable(member.select("doc", "text_hash", *_KEY)), ["doc", "text_hash"]).select(*_KEY, "text")
    sets_of = stash(_shingled(texts).dropDuplicates(_KEY), "shingles")
    return _counted(small.unionByName(large).join(sets_of, _KEY).select(*unit, "side", *_KEY, "shingles"), unit)
