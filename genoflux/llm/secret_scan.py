"""Operator 7: secrets by pattern and by dictionary-primed compression novelty.

Patterns give the base spans.  Beyond these, a long string whose line mentions something sensitive, before or after it, is
measured by what it adds to the compressed text: the surroundings are compressed with and without it by zstandard, primed
with a raw-content dictionary of identifiers.  A string that neither the dictionary nor the text around it explains costs
about as many bits as it has entropy, and is reported as ``novel``; names and repeated values cost little.  The parts of a
candidate that base spans don't cover are measured for themselves if they are long enough.

The dictionary has common identifiers of programs (``IDENTIFIERS``) and those of the documents themselves (``learn``): names that
at least ``LEAST`` different texts use, counted over all documents, most frequent first, up to ``DICTIONARY`` bytes.  A name whose letters
are as random as a secret's never gets into it, so copies of a text with a secret don't hide that secret.

Defined cases: a null or empty text has no span; repeated rows are scanned each for itself, and count as one text in the
dictionary; names that are equally frequent come in alphabetical order; an empty table gives no row.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, slices, table

KINDS = ("assign", "access", "hex", "novel")
# on bytes in lower case, whose places are those of the text
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_SENSITIVE = re.compile(rb"key|secret|token|passw|pwd|credential|auth|bearer|private|signature|cookie|session")
#: Names of two parts or more: with an underscore, or a capital after a small letter.
_NAME = re.compile(r"(?a:\b(?=[A-Za-z_]{4,64}\b)[A-Za-z_]*?(?:[a-z][A-Z]|[A-Za-z]_[A-Za-z])[A-Za-z_]*)")

_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+")

#: Bits that each byte of a name may add by itself; its parts have three letters or more on average.  Random letters seldom pass both.
NAME_BITS = 6.5
#: Different texts that a name has to be in, and bytes of the names that are kept.
LEAST, DICTIONARY = 3, 64 * 1024
#: Shortest string that is measured.
SHORTEST = 16
#: Bytes on either side that prime the compressor.
AROUND = 512
#: Letters as frequent as in English text (fixed values, in percent), with few capitals, digits and underscores between them: what
#: stands before the surroundings, so that even in a short text the compressor's codes are those of ordinary letters.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)))
USUAL = "".join(random.Random(7).choices([*LETTERS, *map(str.upper, LETTERS), *"0123456789_"], [*LETTERS.values(), *(x / 25 for x in LETTERS.values()), *[0.3] * 11], k=1024)).encode()
#: Bits that each byte of a candidate has to add to the compressed text; identifiers add up to 4.7, random hexadecimal digits 6.
NOVEL_BITS = 5.5
#: What programs and configurations are full of; a string made of these is no secret.
IDENTIFIERS = b" ".join(
    x + y
    for x in (b"get", b"set", b"is", b"on", b"create", b"update", b"delete", b"user", b"default", b"max", b"min", b"my_", b"test_", b"public_", b"private_")
    for y in (b"Name", b"Value", b"Token", b"Key", b"Secret", b"Password", b"Session", b"Config", b"Client", b"Server", b"Request", b"Response", b"_id", b"_key", b"_name", b"_path", b"_value", b"_token")
) + b" abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef https://www.example.com/path/index.html 00000000-0000-0000-0000-000000000000 2020-01-01T00:00:00 sha256 base64 utf-8 localhost 127.0.0.1 "


def free(base: list[tuple[int, int]], a: int, z: int) -> Iterator[tuple[int, int]]:
    """Stretches of a to z of SHORTEST bytes or more that no span of base, which is sorted, covers."""
    for p, q in [*base, (z, z)]:
        if p - a >= SHORTEST:
            yield a, min(p, z)
        a = max(a, q)
        if a >= z:
            return


class Scanner:
    """Spans of secrets in texts, as (kind, start, end) in code points."""

    def __init__(self, names: bytes = b"", bits: float = NOVEL_BITS) -> None:
        words = zstandard.ZstdCompressionDict(names + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # optimal parsing with matches from three bytes on, so that parts of identifiers are found
        params = zstandard.ZstdCompressionParameters.from_level(16, min_match=3, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.squeeze = zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress
        self.bits = bits

    def novelty(self, raw: bytes, a: int, z: int) -> float:
        """Bits that each byte of raw[a:z] adds to its compressed surroundings."""
        before, after = USUAL + raw[max(0, a - AROUND) : a], raw[z : z + AROUND]
        own = raw[a:z].lower() if raw[a:z].isupper() else raw[a:z]  # a name in capitals is a name
        return 8 * (len(self.squeeze(before + after + own)) - len(self.squeeze(before + after))) / (z - a)

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        raw = text.encode("utf-8", "surrogatepass")
        low = raw.lower()
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(low) if len(m[1]) >= 12]
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
        found += [("hex", *m.span()) for m in _HEX.finditer(raw)]
        base = sorted((a, z) for _, a, z in found)
        if words := [m.span() for m in _SENSITIVE.finditer(low)]:
            starts = [a for a, _ in words]

            def sensitive(a: int, z: int) -> bool:
                """Whether a sensitive word lies on the line of a candidate, but not within it."""
                lo, hi = raw.rfind(b"\n", 0, a) + 1, raw.find(b"\n", z)
                near = words[bisect_left(starts, lo) : bisect_left(starts, hi if hi >= 0 else len(raw))]
                return any(q <= a or p >= z for p, q in near)

            for m in _CANDIDATE.finditer(raw):
                a, z = m.span()
                for p, q in free(base, a, z):
                    if sensitive(p, q) and self.novelty(raw, p, q) >= self.bits:
                        found.append(("novel", p, q))
        found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        if len(raw) == len(text):
            return found
        places: dict[int, int] = {}
        last = at = 0
        for x in sorted({y for _, a, z in found for y in (a, z)}):
            at += len(raw[last:x].decode("utf-8", "surrogatepass"))
            last, places[x] = x, at
        return [(k, places[a], places[z]) for k, a, z in found]


def learn(docs: DataFrame, least: int = LEAST, most: int = DICTIONARY) -> bytes:
    """The documents' own identifiers, most frequent last, where zstandard finds them at the least distance."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        scanner = Scanner()
        for b in slices(batches):
            texts, names = [], []
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist()):
                for x in set(_NAME.findall(text)) if text else ():
                    if x not in known:
                        if len(known) > 100_000:
                            known.clear()
                        raw = x.encode()
                        known[x] = len(raw) >= 3 * len(_PART.findall(x)) and scanner.novelty(raw, 0, len(raw)) < NAME_BITS
                    if known[x]:
                        texts.append(h)
                        names.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(names, pa.string())], names=["h", "name"])

    read = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    counts = read.mapInArrow(task, "h bigint, name string").distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # a name has three bytes at least, so these fill the dictionary
    rows = counts.orderBy(F.desc("n"), "name").limit(most // 4).collect()
    out, size = [], 0
    for r in rows:
        size += len(r["name"]) + 1
        if size > most:
            break
        out.append(r["name"].encode())
    return b" ".join([*reversed(out), b""]) if out else b""


def scan(docs: DataFrame, names: bytes = b"") -> DataFrame:
    """doc_id and spans (kind, start, stop) of documents; names are those that learn() returns."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_table()
        scanner = Scanner(names)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in slices(batches):
            spans = [[{"kind": k, "start": a, "stop": z} for k, a, z in scanner.scan(x)] if x else [] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(task, f"doc_id {dict(read.dtypes)['doc_id']}, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def redact(docs: DataFrame, names: bytes = b"", mark: str = "[SECRET]") -> DataFrame:
    """documents with every span replaced by a mark (overlapping spans by one) and n_chars made anew; columns stay."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_table()
        scanner = Scanner(names)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            for i, x in enumerate(texts):
                if x and (spans := scanner.scan(x)):
                    out, at = [], 0
                    for _, a, z in spans:
                        if a >= at:
                            out += [x[at:a], mark]
                        at = max(at, z)
                    texts[i] = "".join(out) + x[at:]
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    out = docs.mapInArrow(task, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "novel"))
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs)).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("novel"))
