"""Packing of token pieces into fixed-size sequences: shortest pack first over
the length histogram.

Method.  A document's ids are cut into full sequences and one remainder.  The
histogram of piece lengths (at most ``size`` rows) is packed longest first:
each length goes to the shortest pack that is open, many equal packs at a time,
so only counts of packing patterns change.  Every slot of a pattern then owns a
range of ranks among the pieces of its length, and pieces find their sequence
and offset by (length, rank).

Scale.  Tokenising is one pass over the texts, in small Arrow batches, with a
word cache of bounded size in each process; pieces are written once.  Ranks
are counted within hash buckets of the rows, and a bucket's base is the sum of
the smaller buckets' counts, so a length that a third of all pieces have is
spread over all buckets.  Only the histogram comes to the driver, and only the
slot table (bounded by ``size``, not by the input) is broadcast.

Defined cases.  A null or empty text is the end id alone.  Repeated rows are
packed each.  An empty table gives no rows.  Of the input only the id and text
columns are used.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import string
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrid.llm.arrow import Cache, slices, values
from jobgrid.llm.frames import small_batches, store, text_of

SIZE = 2048
END_ID = 1
#: words in a generation of the cache; two are kept
CACHED_WORDS = 200_000
#: pieces that a task of the last step has at least, beyond one task a core
TASK_PIECES = 100_000


#: what may stand beside a run of marks, which is a unit of its own
_PLAIN = (string.ascii_letters + string.digits + string.whitespace + ".,").encode()
_MARKS_TOGETHER = (b"..", b",,", b".,", b",.")
#: an apostrophe may be one unit with the letters after it
_MARKS = string.punctuation.replace("'", "").encode()
_RUNS = re.compile(b"[" + re.escape(_MARKS) + b"]+")


class WordCache(Cache):
    """``Cache`` for many repeated keys: the lists' new keys are found as a set."""

    def look_up(self, lists: list[list]) -> list[list]:
        now = self.now
        missing = set(chain.from_iterable(lists)).difference(now)
        if missing:
            old = self.old
            now.update((k, old[k]) for k in missing if k in old)
            missing = [k for k in missing if k not in now]
            now.update(zip(missing, self.make(missing)))
        out = [list(map(now.__getitem__, keys)) for keys in lists]
        if len(now) > self.limit:
            self.now, self.old = {}, now
        return out


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of whole texts under a tokenizer
    that never joins two blank-separated words; words are encoded once and
    kept in a bounded cache."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache = WordCache(self._encode, CACHED_WORDS)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix") or None
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end a unit
        if suffix:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.folded: dict[str, str | None] = {}

    def _fold(self, c: str) -> str | None:
        """The letter that the tokenizer makes of a letter outside ASCII; None
        unless it is one letter whatever stands beside it."""
        if c not in self.folded:
            made = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            joins = any(a <= c <= b for a, b in (("\u1100", "\u11ff"), ("\ua960", "\ua97f"), ("\ud7b0", "\ud7ff")))  # Jamo
            plain = c.isalpha() and unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and not joins
            self.folded[c] = made if plain and len(made) == 1 and made.isalpha() and made not in string.ascii_letters else None
        return self.folded[c]

    def _words(self, text: bytes) -> list[bytes]:
        """Blank-separated parts.  A text of letters, digits and marks but the
        apostrophe is normalised first, as the tokenizer would: letters small,
        each by itself; and runs of marks are cut off as the units that they
        are, so that there are fewer kinds of words.  Letters that change
        otherwise (into two, or with a mark beside them), apostrophes and
        control characters leave the text to the tokenizer, word by word."""
        more = text.translate(None, _PLAIN)  # marks but stops and commas, and what is not ASCII
        rest = more.translate(None, _MARKS)
        if rest:
            kinds = set(rest.decode())
            folds = {c: self._fold(c) for c in kinds if c > "\x7f"}
            if len(folds) < len(kinds) or None in folds.values():
                return text.split()
            for c, f in folds.items():
                if c != f:
                    text = text.replace(c.encode(), f.encode())
        text = text.lower()
        if len(rest) < len(more) or any(m in text for m in _MARKS_TOGETHER):
            return _RUNS.sub(rb" \g<0> ", text).split()
        return text.replace(b".", b" . ").replace(b",", b" , ").split()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out = []
        for begin in range(0, len(words), 2000):
            out += self._encode_block([w.decode() for w in words[begin : begin + 2000]])
        return out

    def _encode_block(self, words: list[str]) -> list[bytes]:
        """Words of letters, and of letters and a full stop or comma, are one
        and two units of the tokenizer; they are encoded as one text and told
        apart by the tokens that end a unit.  Others are encoded alone."""
        units = [1 if w.isalpha() else 2 if w[-1] in ".," and w[:-1].isalpha() else 1 if w in (".", ",") else 0 for w in words]
        plain = [w for w, n in zip(words, units) if n]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        first = np.cumsum([0, *(n for n in units if n)])
        if first[-1] != len(stops) - 1 or stops[-1] != len(ids):  # not so for some letters
            units, plain, first, ids, stops = [0] * len(words), [], first[:1], ids[:0], stops[:1]
        at = (4 * stops[first]).tolist()
        blob = ids.astype("<u4").tobytes()
        joint = (blob[a:b] for a, b in zip(at, at[1:]))
        alone = iter(self.tokenizer.encode_batch([w for w, n in zip(words, units) if not n], add_special_tokens=False))
        return [next(joint) if n else np.array(next(alone).ids, "<u4").tobytes() for n in units]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # a text that holds an added token is encoded whole
        whole = [any(s in t for s in self.specials) for t in texts]
        words = [[] if w else self._words(t) for w, t in zip(whole, texts)]
        got = self.cache.look_up(words)
        return [
            np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() if w else b"".join(ids)
            for w, t, ids in zip(whole, texts, got)
        ]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """This process's encoder, kept with its bounded cache for the next tasks."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece;
    ``ids``: the piece's ids, little-endian unsigned 32-bit."""

    def cut(batches):
        encode = encoder(tokenizer_path)
        for batch in slices(batches, "t", 1 << 20):
            keys, start, length, crc, total, ids, row = [], [], [], [], [], [], []
            for i, b in enumerate(encode(values(batch.column("t")))):
                b += END_ID.to_bytes(4, "little")
                n = len(b) // 4
                for s in range(0, n, size):
                    part = b[4 * s : 4 * (s + size)]
                    row.append(i), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n)
                    if with_ids:
                        ids.append(part)
            cols = [batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        batch = None
        pa.default_memory_pool().release_unused()  # the process lives on; what the texts took does not

    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return src.mapInArrow(cut, schema)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), packed longest first, each
    length into the shortest open pack."""
    by_space: dict[int, list[list]] = defaultdict(list)  # space left: [lengths, count]
    spaces: list[int] = []  # those with open packs, ascending

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if space not in by_space:
            bisect.insort(spaces, space)
        by_space[space].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and spaces and spaces[-1] >= length:
            space = spaces[-1]
            entry = by_space[space][-1]
            taken = min(left, entry[1])
            entry[1] -= taken
            if not entry[1]:
                by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
                    spaces.pop()
            put(space - length, (*entry[0], length), taken)
            left -= taken
        each = size // length
        if left >= each:
            put(size - each * length, (length,) * each, left // each)
        if left % each:
            put(size - left % each * length, (length,) * (left % each), 1)
    return [(pattern, count) for entries in by_space.values() for pattern, count in entries]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of
    every slot: the pieces of that length and rank lie in sequence ``first
    sequence + rank - first rank`` at ``offset``."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            first = next_rank[length]
            next_rank[length] += count
            out.append((length, first, first + count, sequence, offset))
            offset += length
        sequence += count
    return out


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    slots = spark.createDataFrame(
        slot_table(pack_histogram(histogram, size)) or [], "length long, rank_from long, rank_to long, seq_from long, offset long"
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    base = rows.groupBy("length", "bucket").count().select(
        "length", "bucket",
        F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    within = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32"))
    ranked = rows.withColumn("rank", within - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.join(
        F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    ).select(
        *(ranked[c] for c in pieces.columns), (F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    ).coalesce(max(spark.sparkContext.defaultParallelism, sum(histogram.values()) // TASK_PIECES))  # a piece's row is small


def pack(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ``ids``)."""
    with small_batches(docs.sparkSession):
        pieces = store(token_pieces(docs, tokenizer_path, id_col, text_col, size, with_ids), "pieces")
    return assign(pieces, size)
