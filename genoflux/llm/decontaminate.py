"""Operator 2: benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders: a number is a word that starts with a digit, a unit is a word of
``UNITS`` after a number, a name is a capitalised word.  A capitalised word that starts a sentence may be a name or not, so texts
have two readings: in the first it is an ordinary word, in the second a name.  Windows of ``WINDOW`` words are hash-joined between documents and benchmark items of
the same reading, so a question with other parameters still meets its original.  All matched windows of a document and an item
that lie on one diagonal must then fill their slots consistently: one value of the item always has the same value in the document.

An item of fewer words is one window of its own length.  Windows with slots count if ``LITERALS`` of their words are plain ones, as
others would match anywhere; an item without such a window is matched by its plain words, a third reading.  Items of fewer than ``SHORTEST`` words match documents that consist of these words alone; items
without a word match nothing.  Items with the same template and the same slots equal are a family: its windows and their
consistency are found once, and every match is then given to all its items, those with equal texts included.

The documents' windows are looked up in the sorted hashes of the benchmark's, if these are at most ``FILTER`` (8 bytes each),
and only those found are shuffled; beyond that all windows are.

Defined cases: null and empty texts match nothing; repeated rows are reported once for each item; rows are told apart by doc_id and
the hash of the text; of several diagonals or readings of one item the one with most windows, then slots, then changed slots is
reported; an empty table on either side gives no match.  Other columns are ignored, or kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, slices, stash, table, unused

WINDOW, LITERALS, SHORTEST = 13, 5, 5
#: The reading of plain words.
PLAIN = 2
#: Items of a family that meet its matches in one task, about.
PART = 64
FILTER = 4_000_000
#: Units of measure, as written after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds"
    " ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months"
    " year years hz khz mhz ghz w kw mw v a j kj cal kcal c f k mph kph % percent dollar dollars cent cents euro euros usd eur degrees".split()
)
_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<unit>", "<name>"))
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes, as estimated, after which a worker's table of words starts afresh, and those of an entry beside its text.
WORDS_BYTES, _ENTRY = 24 << 20, 49 + 36 + 40


class Words(dict):
    """What each word is, by its text: (hash of the plain word, starts with a digit, unit, capitalised, ends a sentence); in 64 bits."""

    size = 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def __missing__(self, word: str) -> int:
        plain = _EDGES.sub("", word)
        if not plain:
            code = 16 if word[-1:] in ".!?" else 0  # no word, but it may end a sentence
        else:
            low = plain.lower()
            code = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~63 | 32
            code |= plain[0].isdigit() * 1 | (low in UNITS) * 2 | (plain[0].isupper() and not plain[0].isdigit()) * 4 | (word.rstrip("\"')]»”’")[-1:] in ".!?:") * 16
        self.size += len(word) + _ENTRY
        if self.size > WORDS_BYTES:
            self.clear()
        self[word] = code
        return code


_WORDS = Words()


class Read:
    """Words of a batch of texts, and (codes, slots) of each reading."""

    def __init__(self, texts: list[str | None]) -> None:
        split = [x.split() if x else [] for x in texts]
        codes = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(split)), np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        first = np.r_[True, text[1:] != text[:-1]][: len(text)]
        flag = lambda bit: (codes & np.uint64(bit)) != 0
        word, after = flag(32), lambda x: np.r_[False, x[:-1]][: len(x)] & ~first
        number = flag(1)
        unit = flag(2) & after(number)
        capital = flag(4) & ~number & ~unit
        starts = first | after(flag(16))
        self.words, self.text = (codes & ~np.uint64(63))[word], text[word]
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.begin = np.cumsum(self.counts) - self.counts
        self.readings = []
        for name in (capital & ~starts, capital):
            slot = (number | unit | name)[word]
            self.readings.append((np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], codes & ~np.uint64(63))[word], slot))
        self.readings.append((self.words, np.zeros(len(self.words), bool)))

    def windows(self, lengths: list[int], once: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Length, reading, hashes from each word on, and which of these windows count, for each of these lengths and readings.

        If once is set, windows that are the same in the first two readings count in the first one only."""
        wanted, before = set(lengths), {}
        for reading, (codes, slot) in enumerate(self.readings):
            total, h = np.r_[0, np.cumsum(~slot)], np.zeros(len(codes), np.uint64)
            for n in range(1, min(max(wanted, default=0), len(codes)) + 1):
                h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
                if n not in wanted:
                    continue
                out = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                out = out ^ (out >> np.uint64(32)) ^ np.uint64(n + (reading == PLAIN) * 64)
                ok = self.text[: len(out)] == self.text[n - 1 :]
                if n < SHORTEST:
                    ok &= (reading == PLAIN) & (self.counts[self.text[: len(out)]] == n)
                elif reading < PLAIN:
                    ok &= total[n:] - total[:-n] >= min(LITERALS, n)
                if reading == 0:
                    before[n] = out
                elif reading < PLAIN and once:
                    ok &= out != before[n]
                yield n, reading, out, ok


def slot_classes(codes: np.ndarray, words: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a text the number of its slot's value, -1 without a slot; and the values, by their first place."""
    numbers: dict[int, int] = {}
    own = np.array([numbers.setdefault(w, len(numbers)) if s else -1 for w, s in zip(words.tolist(), slot.tolist())], np.int64)
    return own, np.array(list(numbers), np.uint64)


def families(benchmark: DataFrame) -> DataFrame:
    """Rows (family, item_id, text, reading, values) of items (item_id, text), for each reading that differs from those before.

    Items of a family have the same template and the same slots equal, so whatever matches one matches all of them; values are those
    of the slots, in the family's order."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, texts = [], b.column("text").to_pylist()
            read = Read(texts)
            usual = np.zeros(len(texts), bool)  # some window with slots counts
            for n, reading, _, ok in read.windows(list(range(SHORTEST, WINDOW + 1))):
                if reading < PLAIN:
                    own = read.text[np.flatnonzero(ok)]
                    usual[own[np.minimum(read.counts[own], WINDOW) == n]] = True
            for item, text, at, k, by_slots in zip(b.column("item_id").to_pylist(), texts, read.begin.tolist(), read.counts.tolist(), usual.tolist()):
                words, last = read.words[at : at + k], None
                for reading, (codes, slot) in enumerate(read.readings):
                    codes = codes[at : at + k]
                    if not k or (reading == PLAIN) == by_slots or (last is not None and (codes == last).all()):
                        continue
                    own, values = slot_classes(codes, words, slot[at : at + k])
                    last = codes
                    rows.append((xxhash.xxh3_128_digest(bytes([reading]) + codes.tobytes() + own.tobytes()), item, text, reading, values.view(np.int64)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["family", "item_id", "text", "reading", "values"])

    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(task, "family binary, item_id bigint, text string, reading int, values array<bigint>")


def family_windows(items: DataFrame) -> DataFrame:
    """Rows (hash, n, family, at, classes) for families; classes are the numbers of the values in the window's slots."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for family, text, own_reading in zip(*(b.column(x).to_pylist() for x in ("family", "text", "reading"))):
                read = Read([text])
                codes, slot = read.readings[own_reading]
                own = slot_classes(codes, read.words, slot)[0]
                for n, reading, h, ok in read.windows([min(WINDOW, len(codes))]):
                    if reading == own_reading:
                        rows += [(int(h[i]), n, family, int(i), own[i : i + n][own[i : i + n] >= 0].tolist()) for i in np.flatnonzero(ok)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            hashes = pa.array(np.array(cols[0], np.uint64).view(np.int64))
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([hashes, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=["hash", "n", "family", "at", "classes"])

    one = items.groupBy("family").agg(F.min(F.struct("text", "reading")).alias("first")).select("family", "first.*")
    return one.mapInArrow(task, "hash bigint, n int, family binary, at bigint, classes array<bigint>")


def family_matches(docs: DataFrame, benchmark: DataFrame, most_filter: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """A row for each document, family and diagonal with consistent windows: doc_id, text_hash, family, n_windows, filled; and the families.

    filled has the number of each value of the family in these windows and what the document has there."""
    spark = docs.sparkSession
    known_items = stash(families(benchmark), "families")
    items = stash(family_windows(known_items), "items")
    lengths = [r["n"] for r in items.select("n").distinct().collect()]  # WINDOW at most
    distinct = items.select("hash").distinct()
    size = distinct.count()
    known = None
    if size <= most_filter:  # 8 bytes each
        known = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_table(_WORDS)
        if known is not None:
            hashes = known.value
            low = np.zeros(1 << 20, bool)  # a first look, by 20 bits
            low[hashes & np.uint64((1 << 20) - 1)] = True
        for b in slices(batches):
            rows, found, read = [], [], Read(b.column("text").to_pylist())
            values = read.words.view(np.int64)
            for n, reading, h, ok in read.windows(lengths, once=True):
                if known is not None:
                    at = np.flatnonzero(ok & low[h & np.uint64((1 << 20) - 1)])
                    at = at[hashes[np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)] == h[at]] if len(hashes) else at[:0]
                else:
                    at = np.flatnonzero(ok)
                if len(at):
                    slot, text = read.readings[reading][1], read.text[at]
                    rows += text.tolist()
                    found += [(x, y, values[i : i + n][slot[i : i + n]].tolist()) for x, y, i in zip(h[at].view(np.int64).tolist(), (at - read.begin[text]).tolist(), at.tolist())]
            cols = list(zip(*found)) if found else [[]] * 3
            take = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_hash").take(take), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "text_hash", "hash", "doc_at", "doc_values"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    there = read.mapInArrow(task, "doc_id bigint, text_hash bigint, hash bigint, doc_at bigint, doc_values array<bigint>")
    met = there.join(items.select("hash", "family", "at", "classes"), "hash").withColumn("diagonal", F.col("doc_at") - F.col("at"))
    group = ["doc_id", "text_hash", "family", "diagonal"]
    # one row for each slot of each window, or one without a slot
    filled = met.select(*group, F.explode_outer(F.arrays_zip(F.col("classes").alias("number"), F.col("doc_values").alias("doc_value"))).alias("slot"), "at")
    value = filled.groupBy(*group, F.col("slot.number").alias("number")).agg(F.min("slot.doc_value").alias("low"), F.max("slot.doc_value").alias("high"), F.collect_set("at").alias("ats"))
    judged = value.groupBy(*group).agg(
        F.max(F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("clash"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("bigint").alias("n_windows"),
        F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "low"))).alias("filled"),
    )
    return judged.where(~F.col("clash")).select("doc_id", "text_hash", "family", "n_windows", "filled"), known_items


def matches(docs: DataFrame, benchmark: DataFrame, most_filter: int = FILTER) -> DataFrame:
    """A row for each document and item that share consistent windows: doc_id, text_hash, item_id, n_windows, n_slots, n_changed."""
    found, items = family_matches(docs, benchmark, most_filter)
    # the items of a large family are dealt to parts, and what matches it goes to each
    parts = items.groupBy("family").agg(F.ceil(F.count("*") / PART).cast("bigint").alias("parts"))
    dealt = items.join(parts, "family").select("family", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part"), "item_id", "values")
    spread = found.join(parts, "family").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    changed = F.size(F.filter("filled", lambda x: F.get("values", x["number"].cast("int")) != x["low"])).cast("bigint")
    met = spread.join(dealt, ["family", "part"]).select("doc_id", "text_hash", "item_id", "n_windows", F.size("filled").cast("bigint").alias("n_slots"), changed.alias("n_changed"))
    best = F.max(F.struct("n_windows", "n_slots", "n_changed")).alias("best")
    return met.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that match an item."""
    own = [unused(docs, x) for x in ("hit_id", "hit_hash")]
    hit = family_matches(docs, benchmark)[0].select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(own[0]), F.col("text_hash").alias(own[1]))
    hit = stash(hit.distinct(), "leaks")
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(1 << 63))) == hit[own[0]]) & (F.xxhash64(docs["text"]) == hit[own[1]])
    return docs.join(hit, same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
