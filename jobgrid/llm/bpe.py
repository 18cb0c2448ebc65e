"""Byte-level BPE encoding by backtracking, decoding by an offset table.

Method.  An Aho-Corasick automaton over the vocabulary finds the longest token
at each position of a word.  The encoder appends it if it is compatible with
the token before, that is if merging the two tokens' bytes would give exactly
these two tokens; else it tries the next shorter token, and steps back when
none fits.  A position that was given up is never entered again, so the work
is linear and the result is exactly that of merging by rank.  Compatibility of
a pair is found by undoing merges, the younger first, and kept in a table.
Decoding gathers the tokens' bytes from one blob through an offset table.

Scale.  One pass over the texts, no shuffle.  Words are encoded once per task
and kept in a bounded cache; texts are worked on in slices of bounded size.

Defined cases.  A null or empty text has no ids.  The text of an added token
stands for that token.  Repeated rows are encoded each.  Of the input only the
id and text columns are used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from jobgrid.llm.arrow import Cache, slices, utf8
from jobgrid.llm.frames import text_of

#: how byte-level BPE cuts a text into words (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others, in order, as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable}
    return chars | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}


class _Added(NamedTuple):
    """An added token in a text; not the word of the same letters."""

    text: str


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char = _byte_of_char()
        raw = lambda t: bytes(char[c] for c in t)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        # tokens are numbered by age: single bytes, then one per merge
        age = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = raw(a), raw(b)
            if left + right not in age:
                age[left + right] = len(self.parts)
                self.parts.append((age[left], age[right]))
            self.merged.setdefault((age[left], age[right]), age[left + right])
        self.length = [len(t) for t in age]
        self.id_of = [vocab[t] for t in age]
        self.shorter = [next((age[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in age), -1) for t in age]
        self.automaton = ahocorasick.Automaton()
        for t, k in age.items():
            self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.words = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.cache = Cache(self._encode_words)
        # the offset table: token i is blob[offset[i]:offset[i + 1]]
        by_id = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, merged by rank, give a then b.
        Undoes the younger of the two tokens at the seam again and again; no
        merge across the seam may be older than the merge undone last."""
        key, parts, merged = (a, b), self.parts, self.merged
        if key in self.fits:
            return self.fits[key]
        newest, good = len(parts), True
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < newest:
                good = False
                break
            if max(a, b) < 256:
                break
            if a > b:
                newest, a = a, parts[a][1]
            else:
                newest, b = b + 1, parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one word, numbered by age."""
        n, length, shorter = len(word), self.length, self.shorter
        longest = [0] * n
        for end, t in self.automaton.iter(word.decode("latin-1")):
            longest[end - length[t] + 1] = t
        out: list[int] = []
        given_up = bytearray(n + 1)
        at, t = 0, longest[0]
        while True:
            end = at + length[t]
            if not given_up[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at == n:
                    return out
                t = longest[at]
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                given_up[at] = 1
                t = out.pop()
                at -= length[t]

    def _encode_words(self, words: list[str]) -> Iterator[tuple[bytes, str]]:
        for w in words:
            ids = [self.added[w.text]] if isinstance(w, _Added) else [self.id_of[t] for t in self.encode_word(w.encode())]
            yield np.array(ids, "<i4").tobytes(), ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """Per text, its words' ids as little-endian 32-bit integers and as
        decimals joined by commas."""
        pieces = []
        for t in texts:
            if self.split_added and any(a in t for a in self.added):
                parts = self.split_added(t)
                pieces.append([*chain.from_iterable([_Added(p)] if k % 2 else self.words(p) for k, p in enumerate(parts))])
            else:
                pieces.append(self.words(t))
        return self.cache.look_up(pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        first, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(size)
        return self.blob[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def _texts(batch: pa.RecordBatch) -> list[str]:
    at, data = utf8(batch.column("t"))
    raw, at = memoryview(data), at.tolist()
    return [str(raw[a:b], "utf-8") for a, b in zip(at, at[1:])]


def _per_text(docs: DataFrame, path: str, id_col: str, text_col: str, columns: dict[str, pa.DataType], row: Callable) -> DataFrame:
    """One row per document: its id and what ``row(bpe, words)`` gives."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    schema = StructType([StructField("doc_id", src.schema["id"].dataType), *(StructField(c, from_arrow_type(t)) for c, t in columns.items())])

    def run(batches):
        bpe = Bpe(path)
        for batch in slices(batches, "t", 1 << 20):
            rows = [row(bpe, words) for words in bpe.encode(_texts(batch))]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows), columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["doc_id", *columns])

    return src.mapInArrow(run, schema)


def _ids(words: list[tuple[bytes, str]]) -> np.ndarray:
    return np.frombuffer(b"".join([w[0] for w in words]), "<i4")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _per_text(docs, path, id_col, text_col, {"ids": pa.list_(pa.int32())}, lambda bpe, words: (_ids(words),))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null ids count as none."""
    src = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        bpe = Bpe(path)
        for b in batches:
            texts = [bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256
    (of the decimal ids joined by commas) and decoded_sha256."""

    def row(bpe, words):
        ids = _ids(words)
        listed = hashlib.sha256(",".join([w[1] for w in words]).encode())
        return len(ids), listed.hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _per_text(docs, path, id_col, text_col, columns, row)
