"""Operator 3: language by compression.

Each language has a zstandard raw-content dictionary of text in that language, letters only and in lower case.  A text,
reduced in the same way, is cut into short blocks, every block is compressed with every dictionary, and the language
whose blocks are smallest in total wins; short blocks keep the dictionary, not the text's own repetitions, in charge.  A
short text is measured by what it adds to a primer in each language.  A narrow margin between the two smallest is a
rejection.

Learning: dictionaries are made of ``SLICE`` characters at a hash-chosen place of at most ``SAMPLE`` labelled rows for each
language, which bounds the model by ``DICTIONARIES`` bytes in all.  Predicting reads whole texts and nothing but texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; ties go to the first language in
alphabetical order; without a labelled row everything is ``und``; repeated rows are judged each for itself; an empty table
gives no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, keep_table, slices, table

#: Labelled rows for each language, and characters taken from each.
SAMPLE, SLICE = 400, 600
#: Bytes of one dictionary, and of all together.
DICTIONARY, DICTIONARIES = 128 * 1024, 8 * 1024 * 1024
#: Bytes of a block; shorter texts than SHORT follow a primer of PRIMER bytes from the dictionary's end.
BLOCK, SHORT, PRIMER = 512, 256, 2048
#: Share of the second smallest size by which the smallest has to be less.
MARGIN = 0.02

#: Letters, and a few characters like fractions and circled numbers, which are none.
_LETTERS = re.compile(r"[^\W\d_]+")


def reduced(text: str) -> bytes:
    """Letters in lower case; what lies between them becomes a space."""
    words = _LETTERS.findall(text.lower())
    out = " ".join(words)
    if not "".join(words).isalpha():
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return out.encode("utf-8", "surrogatepass")


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries of labelled documents (text, lang); rows without either are left out."""
    d = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return {}
    # a hash below this gives about twice the rows wanted of each language, so the exact choice sorts few
    share = F.create_map(*[F.lit(y) for k, n in counts.items() for y in (k, min(1.0, 2.0 * SAMPLE / n + 20 / n))])
    at = F.xxhash64("text")
    draw = (F.pmod(at, F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    place = (F.pmod(F.shiftright(at, 32), F.greatest(F.lit(1), F.length("text") - SLICE)) + 1).cast("int")
    few = d.select("lang", "text", at.alias("at"), draw).where(F.col("draw") < share[F.col("lang")]).select("lang", "at", F.substr("text", place, F.lit(SLICE)).alias("part"))
    few = few.dropDuplicates(["lang", "at"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("rank") <= SAMPLE)
    most = min(DICTIONARY, DICTIONARIES // len(counts))
    parts: dict[str, list[bytes]] = {}
    for r in few.orderBy("lang", "at").collect():  # SAMPLE rows of SLICE characters for each language
        parts.setdefault(r["lang"], []).append(reduced(r["part"]))
    return {lang: b"\n".join(evenly(x, most)) for lang, x in sorted(parts.items())}


def evenly(parts: list[bytes], most: int) -> list[bytes]:
    """The beginnings of all parts, of one length at most, which fill most bytes with the line feeds between them."""
    left, sizes, rest = most - len(parts) + 1, sorted(map(len, parts)), len(parts)
    for n in sizes:  # what short parts leave goes to the others
        if n * rest > left:
            return [x[: max(0, left // rest)] for x in parts]
        left, rest = left - n, rest - 1
    return parts


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, window_log=18, search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.squeeze, self.primers, self.primed = [], [], []
        for x in self.langs:
            n = min(PRIMER, len(dictionaries[x]) // 2)
            words, primer = dictionaries[x][: len(dictionaries[x]) - n], dictionaries[x][len(dictionaries[x]) - n :] + b" "
            words = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.squeeze.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress)
            self.primers.append(primer)
            self.primed.append(len(self.squeeze[-1](primer)))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is too narrow."""
        raw = reduced(text) if text and self.langs else b""
        if not raw:
            return "und", 0.0, True
        if len(raw) < SHORT:
            sizes = [max(1, len(f(p + raw)) - n) for f, p, n in zip(self.squeeze, self.primers, self.primed)]
        else:
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = [sum(len(f(x)) for x in blocks) for f in self.squeeze]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        # bytes saved are evidence, at a discount as neighbouring bytes aren't independent
        score = 1 / sum(math.exp(max(-700.0, (sizes[best] - s) / 4)) for s in sizes)
        return self.langs[best], score, second - sizes[best] < MARGIN * second


def classify(docs: DataFrame, dictionaries: dict[str, bytes], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """documents with a language, a score and whether it is rejected, under these names; other columns stay, but for columns of these names."""
    told = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICTIONARIES bytes

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_table()
        model = Classifier(told.value)
        for b in slices(batches):
            found = [model.classify(x) for x in b.column("text").to_pylist()]
            cols = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    read = docs.drop(*names)
    kinds = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return read.mapInArrow(task, T.StructType([*read.schema.fields, *kinds]))


def held_out(doc_id: Column) -> Column:
    """Documents that dictionaries never learn from."""
    return crc_mod(doc_id, 4) == 2


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
