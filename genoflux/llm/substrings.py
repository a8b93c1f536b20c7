"""Operator 9: exact repeated substrings, by longest-previous-factor arrays over anchored parts of the suffix order.

A string of ``length`` bytes that occurs twice has the same smallest hash among its ``GRAMS[0]``-byte substrings at both
places.  That anchor partitions all windows of the corpus, so windows with different anchors never have to meet:

1. Each text's windows are grouped into blocks, runs of neighbouring windows with one anchor (about one row for 85 bytes).
2. Blocks whose anchor occurs once in the corpus go; counting is pre-aggregated.
3. Blocks that are equal as a whole (in 128 bits of hash) are one kind, and repeated as a whole.
4. Of every kind the bytes of its first block are fetched.  Those of one anchor meet in a task, which sorts their suffixes, has the
   longest common prefixes of neighbours, and finds the previous and the next smaller place of each; the longer of the two common prefixes is the window's longest previous factor, up to ``length``.  A window whose factor has
   ``length`` bytes is a later copy, and where it was found is an earlier one.
5. Anchors with more than ``MOST`` kinds are split by longer anchors: steps 1 to 4 again for their blocks, with the next of ``GRAMS``.
   The last is ``length`` itself, with which blocks of one anchor are equal.

``keep_first`` removes later copies only (earlier means a smaller doc_id, then a smaller place); otherwise every byte of a
repeated window goes.

Defined cases: null texts are empty; texts shorter than ``length`` stay whole; repeated rows repeat each other, and
``keep_first`` takes rows with the same doc_id and text for one; a null doc_id comes first; an empty table gives no row.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, slices, stash, table

LENGTH = 200
#: Bytes of an anchor, and of those that split large groups before the last, which is a window.
GRAMS = (32, 96)
#: Different blocks of one anchor that one task sorts.
MOST = 1024
#: Bytes that are hashed at once, and bytes of blocks that are sorted at once (but for a larger group).
STRIDE, SORTED = 1 << 20, 1 << 18

_BYTE = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64((1 << 64) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place on."""
    h, n, base = _BYTE[raw], 1, _BASE
    out, done = None, 0
    while True:
        if gram & n:
            out = h if out is None else out[: len(h) - done] * np.uint64(base) + h[done:]
            done += n
        if done == gram:
            break
        h = h[:-n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % (1 << 64)
    out = out[: len(raw) - gram + 1]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def blocks(raw: bytes, bounds: list[int], length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """For texts joined in raw, from bounds[i] to bounds[i + 1]: text, first window, last window, anchor of each block."""
    b, starts = np.frombuffer(raw, np.uint8), np.asarray(bounds, np.int64)
    parts = []
    for lo in range(0, max(0, len(raw) - length + 1), STRIDE):
        part = b[lo : lo + STRIDE + length - 1]
        hashes = gram_hashes(part, gram)
        # places within a window decide ties, as they are the same for equal windows
        keyed = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        at = (window_minima(keyed, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        w = np.arange(lo, lo + len(at))
        text = np.searchsorted(starts, w, "right") - 1
        ok = w + length <= starts[text + 1]
        w, at, text = w[ok], at[ok], text[ok]
        if len(w):
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
            last = np.r_[cut[1:] - 1, len(w) - 1]
            parts.append((text[cut], w[cut] - starts[text[cut]], w[last] - starts[text[cut]], hashes[at[cut]].view(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


KEY, KIND = ["doc", "text_hash"], ["anchor", "content"]
SPANS = "doc bigint, text_hash bigint, start bigint, stop bigint"


def _blocks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (doc, text_hash, first, last, anchor, content, raw) of all blocks of texts (doc, text_hash, begin, raw); of documents
    (doc, text_hash, text) without raw."""
    inner = "raw" in texts.columns

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "raw" if inner else "text"):
            raws = [x if inner else (x or "").encode("utf-8", "surrogatepass") for x in b.column("raw" if inner else "text").to_pylist()]
            raw, bounds = b"".join(raws), [0, *np.cumsum([len(x) for x in raws]).tolist()]
            text, first, last, anchor = blocks(raw, bounds, length, gram)
            begin = np.asarray(bounds, np.int64)[text]
            ends = list(zip((begin + first).tolist(), (begin + last + length).tolist()))
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in ends), np.uint64, len(text)).view(np.int64)
            take = pa.array(text)
            cols = {"doc": b.column("doc").take(take), "text_hash": b.column("text_hash").take(take), "first": pa.array(first), "last": pa.array(last), "anchor": pa.array(anchor), "content": pa.array(content)}
            if inner:
                at = b.column("begin").to_numpy()[text]
                cols |= {"first": pa.array(first + at), "last": pa.array(last + at), "raw": pa.array([raw[a:z] for a, z in ends], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return texts.mapInArrow(task, "doc bigint, text_hash bigint, first bigint, last bigint, anchor bigint, content bigint" + ", raw binary" * inner)


def previous_factors(raw: np.ndarray, sizes: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the windows of blocks, which follow each other in raw: block, place, longest previous factor (to length), and where it is.

    order has the rank of each block's occurrence in the corpus.  Where is the number of a window, -1 without a factor."""
    begin, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    block = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    position = order[block] * (int(counts.max(initial=0)) + 1) + place
    # suffix order, to length bytes; places in the corpus ascending among equal ones
    suffix = np.argsort(position)
    held = np.lib.stride_tricks.sliding_window_view(raw, length)[(begin[block] + place)[suffix]]
    own = np.argsort(held.view(f"S{length}")[:, 0], kind="stable")
    suffix, held = suffix[own], held[own]
    position = position[suffix]
    common = np.empty(max(0, len(suffix) - 1), np.int64)
    for lo in range(0, len(common), 4096):
        differ = held[lo : lo + 4096][: len(common) - lo] != held[lo + 1 : lo + 4097]
        common[lo : lo + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    # nearest smaller positions on either side, by jumps over what is larger; and the common prefix on the way there
    longest, where = np.zeros(len(suffix), np.int64), np.full(len(suffix), -1)
    for side in (-1, 1):
        near = np.arange(len(suffix)) + side
        shared = np.r_[0, common] if side < 0 else np.r_[common, 0]
        shared = shared[: len(suffix)]
        near[near == len(suffix)] = -1
        todo = np.flatnonzero(near >= 0)
        while len(todo := todo[(near[todo] >= 0) & (position[near[todo]] > position[todo])]):
            over = near[todo]
            shared[todo], near[todo] = np.minimum(shared[todo], shared[over]), near[over]
        better = (near >= 0) & (shared > longest)
        longest[better], where[better] = shared[better], near[better]
    lpf, source = np.empty_like(longest), np.empty_like(where)
    lpf[suffix], source[suffix] = longest, np.where(where >= 0, suffix[where], -1)
    return block, place, lpf, source


def repeated_windows(raw: np.ndarray, sizes: np.ndarray, order: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Runs of windows of blocks that are found in another (or, with keep_first, an earlier) one: block, first byte, end."""
    block, place, lpf, source = previous_factors(raw, sizes, order, length)
    hit = lpf >= length
    if not keep_first:
        hit[source[hit]] = True
    block, place = block[hit], place[hit]
    cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1)][: len(block)])
    last = np.r_[cut[1:] - 1, len(block) - 1][: len(cut)]
    return block[cut], place[cut], place[last] + length


def _compared(parts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of parts (anchor, open, doc, text_hash, first, raw) that repeat others of their anchor."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            ends = groups.offsets.to_numpy()[1:] - groups.offsets[0].as_py()
            rows = pa.RecordBatch.from_struct_array(groups.flatten())
            sizes = pa.compute.binary_length(rows.column("raw")).to_numpy()
            lo, bytes_to = 0, np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            for k, hi in enumerate(ends):  # equal windows have the same anchor, so groups can share a sort
                if hi > lo and (k + 1 == len(ends) or bytes_to[ends[k + 1]] - bytes_to[lo] > SORTED):
                    part = rows.slice(lo, hi - lo)
                    doc, text_hash, first = (part.column(x).to_numpy() for x in ("doc", "text_hash", "first"))
                    order = np.empty(hi - lo, np.int64)
                    order[np.lexsort((first, text_hash, doc))] = np.arange(hi - lo)
                    raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), np.uint8)
                    block, a, z = repeated_windows(raw, sizes[lo:hi].astype(np.int64), order, length, keep_first)
                    keep = part.column("open").to_numpy(zero_copy_only=False)[block]
                    block, a, z = block[keep], a[keep], z[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[block], text_hash[block], first[block] + a, first[block] + z)], names=[*KEY, "start", "stop"])
                    lo = hi

    grouped = parts.groupBy("anchor").agg(F.collect_list(F.struct("open", *KEY, "first", "raw")).alias("rows"))
    return grouped.select("rows").mapInArrow(task, SPANS)


def _fetched(docs: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """need (doc, text_hash, first, last, anchor, kinds, open) with raw, the bytes of documents."""
    need = need.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "anchor", "kinds", "open")).alias("need"))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for doc, text_hash, text, need in zip(*(b.column(x).to_pylist() for x in (*KEY, "text", "need"))):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(x["anchor"], x["kinds"], x["open"], doc, text_hash, x["first"], raw[x["first"] : x["last"] + length]) for x in need]
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "kinds", "open", *KEY, "first", "raw"])

    joined = docs.join(need.hint("shuffle_hash"), KEY).select(*KEY, "text", "need")
    parts = joined.mapInArrow(task, "anchor bigint, kinds bigint, open boolean, doc bigint, text_hash bigint, first bigint, raw binary")
    return parts.dropDuplicates(["anchor", *KEY, "first"])  # rows may be repeated


def removals(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, most: int = MOST) -> DataFrame:
    """Byte spans (doc, text_hash, start, stop) to remove of rows (doc, text_hash, text); they may overlap."""
    texts, out = docs, []
    for gram in (*(x for x in GRAMS if x < length), length):
        inner = "raw" in texts.columns
        every = stash(_blocks(texts, length, gram), "all")
        # written out, so that the join has an exchange on either side and Spark can split the rows of one anchor
        often = stash(every.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"), "often")
        found = stash(every.join(often, "anchor", "left_semi"), "blocks")
        drop_stash(every)
        earliest = F.min(F.struct(*KEY, "first", "last", *["raw"] * inner)).alias("at")
        kinds = stash(found.groupBy(*KIND).agg(F.count("*").alias("n"), earliest), "kinds")
        equal = found.join(kinds.where(F.col("n") > 1).select(*KIND, "at"), KIND)
        if keep_first:
            equal = equal.where(F.struct(*KEY, "first", "last") != F.struct(*(F.col(f"at.{x}") for x in (*KEY, "first", "last"))))
        out.append(equal.select(*KEY, F.col("first").alias("start"), (F.col("last") + length).alias("stop")))
        # kinds to compare by their bytes; those that are repeated as a whole needn't be looked at for themselves
        open_ = F.lit(True) if keep_first else F.col("n") == 1
        several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(open_).alias("open")).where((F.col("kinds") > 1) & F.col("open"))
        need = kinds.join(several.select("anchor", "kinds"), "anchor").select("at.*", "anchor", "kinds", open_.alias("open"))
        parts = stash(need.drop("last") if inner else _fetched(docs, need, length), "parts")
        last = gram == length  # equal anchors are equal windows then, however many kinds a clash of hashes makes
        out.append(_compared(parts if last else parts.where(F.col("kinds") <= most), length, keep_first))
        texts = parts.where(F.col("kinds") > most).select(*KEY, F.col("first").alias("begin"), "raw")
        if last or texts.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """doc_id, text without what is removed, n_bytes, spans removed (start, stop), kept_sha256 of documents (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    spans = removals(d.select("doc", "text_hash", "text"), length, keep_first)
    spans = spans.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                raw, gone, kept, at = text.encode("utf-8", "surrogatepass"), [], [], 0
                for x in sorted(found or (), key=lambda x: x["start"]):
                    if gone and x["start"] <= gone[-1]["stop"]:
                        gone[-1]["stop"] = max(gone[-1]["stop"], x["stop"])
                    else:
                        gone.append(dict(x))
                for x in gone:
                    kept.append(raw[at : x["start"]])
                    at = x["stop"]
                rest = b"".join((*kept, raw[at:]))
                out.append((rest.decode("utf-8", "ignore"), len(raw), gone, hashlib.sha256(rest).hexdigest()))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), kind, pa.string())))], names=["doc_id", "text", "n_bytes", "spans", "kept_sha256"])

    return d.join(spans.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("doc_id", "text", "found").mapInArrow(cut, "doc_id bigint, text string, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept_sha256 string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicate(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
