"""Exact, cached use of public tokenizers inside Spark tasks.

Both BPE vocabularies used here merge within a pre-token only, so the ids of a text are the
concatenated ids of its pre-tokens.  Texts are cut at boundaries where the pre-tokenizer surely
cuts too (single spaces and newlines), each distinct chunk is encoded once by the ``tokenizers``
library, many in one call, and its ids are kept in a bounded table in the Python worker.  Arrow splits
a batch of texts and finds its distinct chunks, so that the table is asked for each of them once.  A text
with white space that the two may see differently goes to the library whole.  ``tests/llm/test_operators.py`` compares with plain encoding.
"""

from __future__ import annotations

import gc
import os
import re
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute

from .common import keep_table

#: Bytes, as estimated, after which a worker's table of encoded chunks starts afresh.
CACHE_BYTES = 64 << 20
#: New chunks that the library gets at once; each takes some hundred bytes until it is done.
NEW_CHUNKS = 8192
#: Bytes of an entry beside its text and ids: two objects and their places in the dict.
_ENTRY = 49 + 33 + 40
#: Longest chunk, in characters, that is worth keeping.
CACHE_CHARS = 64

if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers")

#: White space other than a space or a line feed.
_ODD_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_FOR_WORDS = re.compile("[\x1c-\x1f\x85]")
#: Characters whose lower case may differ between libraries.
_WIDE = re.compile("[^\x00-\xff]")
#: Letters that end in a combining mark once they are normalised and in lower case; marks after them join it.
_LETTERS_WITH_MARKS = "\u0130\u0958-\u095f\u09dc-\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c-\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40-\ufb41\ufb43-\ufb44\ufb46-\ufb4e"
#: Marks that end a word of letters, and so are a pre-token of their own.
_MARKS = re.compile(rf"([!-/:-@\[-`{{-~](?<=[^\W\d_{_LETTERS_WITH_MARKS}].)[!-/:-@\[-`{{-~]*)(?=\s|\Z)")


class Encoder(dict):
    """ids of whole texts as little-endian unsigned 32-bit bytes; the dict holds chunks' ids."""

    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.by_words = name.startswith("word")
        # ids of tokens that start with white space (byte-level BPE) or end a pre-token
        vocab = self.tokenizer.get_vocab()
        self.at_edge = np.zeros(1 + max(vocab.values()), bool)
        self.at_edge[[i for x, i in vocab.items() if (x.endswith("</w>") if self.by_words else x[:1] in ("\u0120", "\u010a"))]] = True
        self.size = 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _surface(self, chunk: str) -> str:
        """The stretch of text that a chunk stands for."""
        return chunk[1:] if chunk[:1] == "\0" else chunk if self.by_words or chunk[:1] == "\n" else f" {chunk}"

    def spaced(self, text: str) -> str | None:
        """Chunks of a text with a space between them, or None if it has to be encoded whole.  For byte-level BPE a text that starts with no
        white space is preceded by a line feed.

        Marks that end a word are a chunk of their own, after a zero character."""
        if "\0" in text:
            return None
        if self.by_words:
            if _ODD_FOR_WORDS.search(text):
                return None
            text = _MARKS.sub(" \0\\1", text if _WIDE.search(text) else text.lower()).replace("\n", " ")
            return _ODD_SPACE.sub(" ", text)
        text = text.replace("\n", " \n")
        if "  " in text or "\n " in text or _ODD_SPACE.search(text):
            return None
        return _MARKS.sub(" \0\\1", text[1:] if text[:1] == " " else f"\n{text}")

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not in the table yet, all at once where their ids can be told apart."""
        if self.by_words:
            many = [x for x in chunks if x.isalpha() and (x.isascii() or not _WIDE.search(x))]
        else:
            many = [x for x in chunks if x[:1] != "\0" and x not in ("", "\n")]
        for lo in range(0, len(many), NEW_CHUNKS):
            part = many[lo : lo + NEW_CHUNKS]
            self._keep(part, self._together(part))
        rest = [x for x in chunks if x not in self]
        self._keep(rest, [self.plain(self._surface(x)) for x in rest])

    def _keep(self, chunks: list[str], ids: list[bytes]) -> None:
        self.update(zip(chunks, ids))
        self.size += sum(map(len, chunks)) + sum(map(len, ids)) + _ENTRY * len(chunks)

    def _together(self, chunks: list[str]) -> list[bytes]:
        """ids of each chunk, encoded as one text: for byte-level BPE a chunk has white space at its start only, where a pre-token starts too;
        otherwise chunks are words of letters, and so a pre-token each."""
        text = " ".join(chunks) if self.by_words else f" {' '.join(chunks)}".replace(" \n", "\n")
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.at_edge[ids])
        cuts = np.append(0, cuts + 1) if self.by_words else np.append(cuts, len(ids))
        if len(cuts) != len(chunks) + 1 or cuts[0] or cuts[-1] != len(ids):  # letters of different Unicode versions
            return [self.plain(self._surface(x)) for x in chunks]
        raw, ends = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:z] for a, z in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, as bytes."""
        gc.disable()  # nothing here is cyclic, and a collection would walk through all chunks
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        spaced = [self.spaced(x) if x else None for x in texts]
        # each text's chunks as places in the list of the batch's different ones
        cut = pa.compute.split_pattern(pa.array([x for x in spaced if x is not None], pa.large_string()), " ")
        places = cut.flatten().dictionary_encode()
        chunks, at = places.dictionary.to_numpy(zero_copy_only=False).tolist(), places.indices.to_numpy()
        ids = list(map(self.get, chunks))
        gaps = [k for k, x in enumerate(ids) if x is None]
        new = [chunks[k] for k in gaps]
        self._learn(new)
        for k, x in zip(gaps, new):
            ids[k] = self[x]
        table, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = sizes[at]
        ends = np.append(0, np.cumsum(n))
        where = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)
        where += np.arange(ends[-1])
        flat = table[where].tobytes()
        of_text = (4 * ends[cut.offsets.to_numpy()]).tolist()
        bounds = zip(of_text, of_text[1:])
        out = []
        for text, s in zip(texts, spaced):
            if not text:
                out.append(b"")
            elif s is None:
                out.append(self.plain(text))
            else:
                a, z = next(bounds)
                out.append(flat[a if self.by_words or text[0] in " \n" else a + 4 : z])
        if self.size > CACHE_BYTES:
            self.clear()
        for x in [x for x in new if len(x) > CACHE_CHARS]:
            self.pop(x, None)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    keep_table(_ENCODERS[name])
    return _ENCODERS[name]
