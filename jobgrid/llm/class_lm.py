"""Brown class-based bigram model: exchange clustering puts words into classes;
class transitions and word emissions give a text's smoothed probability.

Method.  ``P(text) = prod P(class | class before) * P(word | its class)``; a text
begins after, and ends with, one end token.  Clustering starts from classes by
the words' last bytes.  A round of exchange gathers, for every training word,
how often each class stands before and after it, and moves the word to the
class that raises the log-likelihood ``sum f(N(c, d)) - sum f(N(c, .)) - sum
f(N(., d))``, ``f(x) = x ln x``, the most.  All words of a round choose against the same
table of class pairs; a round that does not raise the likelihood is undone and
is the last.  A transition is interpolated with the class's own share
(``KAPPA`` pseudo-counts), and unknown words, one event, get the share of words
seen once (Good-Turing).  The base score is an add-one unigram.

Scale.  Texts are tokenised once into blocks of at most ``BLOCK`` bytes, written
to the shared folder: token numbers and the block's own dictionary.  What
crosses the network is a block's words, not its tokens: dealt into buckets by
hash, a row for each block and bucket holds their neighbours' classes, and one
comes back with their counts and classes.  Buckets grow in number with the
dictionaries, so that one holds about ``BUCKET`` words of blocks; a word that
stands in all blocks adds at most one entry a block to its bucket.  After the
first round a word is known by its number in its bucket.  The vocabulary stays
spread; only tables of classes x classes and single numbers come to the driver.
All counts are over all training documents.

Defined cases.  A null or empty text is the end token alone.  Words are known
by a 128-bit hash.  A document trains unless ``crc32(id as text) mod FOLDS`` is
``HELD_OUT``; a null id reads as empty text.  Without training documents every
token is unknown and has probability 1 under the class model.  Repeated rows
count and are scored each.  An empty table gives no rows.  Of the input only
the id and text columns are used.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from jobgrid.llm.arrow import slices, values
from jobgrid.llm.frames import text_of
from jobgrid.session import remove_path, write_cut

CLASSES = 32
ROUNDS = 2
#: bytes of text in a block (a longer document is a block of its own)
BLOCK = 32 << 20
#: weight of a class's own share beside its transitions
KAPPA = 32.0
FOLDS, HELD_OUT = 7, 2

#: words of blocks in a bucket, about
BUCKET = 400_000
#: entries worked on at a time, each against all classes
CHUNK = 60_000
#: tokens scored at a time (a longer document at once)
PIECE = 1 << 20

_SMALL = bytes(range(256)).lower()
_ROW = "bucket int, block long, words int, entries int, keys binary, rest binary"
_BLOCK = ("block long, train array<boolean>, ends binary, tokens binary, keys binary, slots binary, cls binary, was binary, counts binary, "
          "words long, kinds long, once long")


def words(text: bytes) -> list[bytes]:
    return text.translate(_SMALL).split()


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^32 with their bytes apart, so that they compress."""
    import zstandard

    planes = [np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(raw: bytes, *sizes: int) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1")
    sizes = sizes or (len(data) // 4,)
    ends = np.cumsum([0, *sizes]) * 4
    return [np.ascontiguousarray(data[a:b].reshape(4, -1).T).view("<u4").ravel() for a, b in zip(ends, ends[1:])]


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x & 0xFFFFFFFF, x >> 32


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


def _blocks(ids: pa.DataType, classes: int, block_bytes: int):
    """Documents (id, train, text) to blocks.  A block's word 0 is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)

        def fresh():
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            return index, [], [], array("i"), array("q"), index[b""]

        def made(index, doc_ids, train, tokens, ends, _) -> pa.RecordBatch:
            kinds = list(index)
            keys = b"".join(map(xxhash.xxh3_128_digest, kinds))
            cls = bytes(zlib.crc32(w[-2:]) % classes for w in kinds)
            row = {
                "ids": pa.array([doc_ids], pa.list_(ids)), "block": pa.array([next(number)]), "train": pa.array([train], pa.list_(pa.bool_())),
                **{c: pa.array([v], pa.binary()) for c, v in (("ends", ends.tobytes()), ("tokens", _pack(np.frombuffer(tokens, np.int32))), ("keys", keys), ("slots", b""), ("cls", cls), ("was", b""), ("counts", b""))},
                "words": pa.array([len(kinds)]), "kinds": pa.array([0]), "once": pa.array([0]),
            }
            return pa.record_batch(list(row.values()), names=list(row))

        state, held = fresh(), 0
        for batch in slices(batches, "text"):
            for key, train, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), values(batch.column("text"))):
                index, doc_ids, trains, tokens, ends, _ = state
                doc_ids.append(key)
                trains.append(train)
                tokens.extend(map(index.__getitem__, words(text)))
                tokens.append(0)
                ends.append(len(tokens))
                held += len(text) + 1
                if held >= block_bytes:
                    yield made(*state)
                    state, held = fresh(), 0
        if state[1]:
            yield made(*state)

    return run


class _Block:
    """One stored block."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        raw = {c: batch.column(c)[i].as_buffer() for c in ("ends", "tokens", "keys", "slots", "cls", "counts")}
        self.number = batch.column("block")[i].as_py()
        self.train = np.array(batch.column("train")[i].as_py(), bool)
        self.ends = np.frombuffer(raw["ends"], np.int64)
        self.tokens = _unpack(raw["tokens"])[0].view(np.int32)
        self.cls = np.frombuffer(raw["cls"], np.uint8)
        self.keys = np.frombuffer(raw["keys"], "<u8").reshape(-1, 2)
        self.slots = raw["slots"]
        self.counts = _whole(*_unpack(raw["counts"], len(self.cls), len(self.cls))) if raw["counts"].size else np.zeros(len(self.cls), np.int64)

    def before(self, x: np.ndarray) -> np.ndarray:
        """The values one token earlier; the first follows an end."""
        return np.concatenate([x[-1:], x[:-1]])  # a block's last token is the end

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(self.ends, prepend=0))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i)


def _class_pairs(classes: int):
    """(c, d, n): how often class d follows class c, a row for each pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in _rows(batches):
            c = b.cls[b.tokens]
            pair = b.before(c).astype(np.int16)
            pair *= classes
            pair += c
            total += np.bincount(pair[b.in_training()], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array((at // classes).astype(np.int32)), pa.array((at % classes).astype(np.int32)), pa.array(total[at])], names=["c", "d", "n"])

    return run


def _neighbours(classes: int, buckets: int):
    """Blocks to rows of their words by bucket: key or number, place in the
    block, class, and the classes beside."""
    wide = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            use = b.in_training()
            t, c = b.tokens, b.cls[b.tokens]
            kinds, m = len(b.cls), int(use.sum())
            # 0 .. C-1: the class before the word; C .. 2C-1: the class after it
            seen = np.empty(2 * m, np.int32 if kinds * wide < 1 << 31 else np.int64)
            for half, word, beside in ((seen[:m], t, b.before(c)), (seen[m:], b.before(t), c + np.uint8(classes))):
                half[:] = word[use]
                half *= wide
                half += beside[use]
            seen.sort()
            new = np.ones(2 * m, bool)
            new[1:] = seen[1:] != seen[:-1]
            first = np.flatnonzero(new)
            n = np.diff(first, append=2 * m).astype(np.int32)
            owner, near = seen[first] // wide, (seen[first] % wide).astype(np.uint8)
            del seen, new, first, t, c, use
            if len(b.keys):
                bucket, number = (b.keys[:, 0] % buckets).astype(np.int32), np.zeros(0, np.int32)
            else:
                bucket, number = _unpack(b.slots, kinds, kinds)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            many = np.bincount(owner, minlength=kinds)
            start = np.concatenate([[0], np.cumsum(many)[:-1]])
            for k in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[k] : bounds[k + 1]]
                lens = many[mine]
                at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
                rest = _pack(mine, b.cls[mine], lens, number[mine] if len(number) else np.zeros(len(mine)), near[at], n[at])
                keys = b.keys[mine].tobytes() if len(b.keys) else b""
                row = [[k], [b.number], [len(mine)], [len(at)], [keys], [rest]]
                yield pa.record_batch([pa.array(v, kind) for v, kind in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "words", "entries", "keys", "rest"])

    return run


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training log-likelihood that depends on the classes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def choose(pairs: np.ndarray, word: np.ndarray, near: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class of each word.  Entries (word, near, n), by word: how
    often class ``near`` stands before (or, from C on, after) it; ``own``: the
    words' classes now, whose counts are taken without the word."""
    classes = len(pairs)
    after = near >= classes
    c = near % classes
    cells = np.where(after[:, None], pairs[:, c].T, pairs[c, :])  # the count that grows if the word joins a class
    rows = np.arange(len(word))
    cells[rows, own[word]] -= n
    gain = xlogx(cells + n[:, None]) - xlogx(cells)
    total = np.zeros((len(own), classes))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        total[word[first]] = np.add.reduceat(gain, first, axis=0)
    for side, margin in ((~after, pairs.sum(0)), (after, pairs.sum(1))):
        m = np.bincount(word[side], n[side], minlength=len(own))[:, None]
        base = np.repeat(margin[None, :], len(own), axis=0)
        base[np.arange(len(own)), own] -= m[:, 0]
        total -= xlogx(base + m) - xlogx(base)
    best = total.argmax(1)
    stay = total[np.arange(len(own)), best] <= total[np.arange(len(own)), own] + 1e-9
    return np.where(stay, own, best)


def _exchange(pairs: np.ndarray):
    """A bucket's rows to its answers, a row for each block: places, classes,
    numbers in the bucket, counts, and which places lead (one of each word)."""
    classes = len(pairs)
    wide = 2 * classes

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack(r["rest"], *[r["words"]] * 4, *[r["entries"]] * 2) for r in rows]
        local, cls, lens, number, near, n = (np.concatenate(x) for x in zip(*parts))
        number = number.astype(np.int64)
        del parts
        if rows[0]["keys"]:
            keys = np.concatenate([np.frombuffer(r["keys"], "<u8").reshape(-1, 2) for r in rows])
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(keys[order], axis=0) != 0).any(1)
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            del keys, order, new
        own = np.zeros(number.max() + 1, np.int64)
        own[number] = cls
        owner = np.repeat(number, lens)
        count = np.bincount(owner[near < classes], n[near < classes], minlength=len(own)).astype(np.int64)
        cell = owner * wide + near
        del owner, near
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order].astype(np.int64)
        del order
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        total = np.add.reduceat(n, first) if len(first) else n
        owner, near = np.divmod(cell[first], wide)
        best = own.copy()
        begin = 0
        while begin < len(owner):  # whole words at a time
            end = np.searchsorted(owner, owner[min(begin + CHUNK, len(owner) - 1)]) if begin + CHUNK < len(owner) else len(owner)
            end = max(end, begin + 1) if end > begin else int(np.searchsorted(owner, owner[begin], side="right"))
            word, at = np.unique(owner[begin:end], return_inverse=True)
            best[word] = choose(pairs, at, near[begin:end], total[begin:end].astype(np.float64), own[word])
            begin = end
        lead = np.zeros(len(number), np.int64)
        lead[np.unique(number, return_index=True)[1]] = 1
        ends = np.cumsum([0, *(r["words"] for r in rows)])
        rest = [_pack(local[a:b], best[number[a:b]] * 2 + lead[a:b], number[a:b], *_halves(count[number[a:b]])) for a, b in zip(ends, ends[1:])]
        out = [table.column("bucket"), table.column("block"), table.column("words"), pa.array([0] * len(rows), pa.int32()), pa.array([b""] * len(rows), pa.binary()), pa.array(rest, pa.binary())]
        return pa.table(out, names=["bucket", "block", "words", "entries", "keys", "rest"])

    return run


def _answered(key, answers: pa.Table, blocks: pa.Table) -> pa.Table:
    """A block with its words' new classes, counts, buckets and numbers."""
    size = blocks.column("words")[0].as_py()
    cls, counts, bucket, number, lead = (np.zeros(size, np.int64) for _ in range(5))
    for r in answers.to_pylist():
        local, marked, numbers, *count = _unpack(r["rest"], *[r["words"]] * 5)
        cls[local], lead[local] = marked >> 1, marked & 1
        bucket[local], number[local], counts[local] = r["bucket"], numbers, _whole(*count)
    binary = {"was": blocks.column("cls")[0].as_py(), "cls": cls.astype(np.uint8).tobytes(), "counts": _pack(*_halves(counts)), "slots": _pack(bucket, number), "keys": b""}
    new = {name: pa.array([value], pa.binary()) for name, value in binary.items()}
    new |= {"kinds": pa.array([int((lead * counts > 0).sum())]), "once": pa.array([int((lead * counts == 1).sum())])}
    for name, value in new.items():
        at = blocks.schema.get_field_index(name)
        blocks = blocks.set_column(at, blocks.schema.field(at), value)
    return blocks


def _pairs(blocks: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros((classes, classes))
    found = blocks.select("block", "train", "ends", "tokens", F.lit(b"").alias("keys"), F.lit(b"").alias("slots"), "cls", F.lit(b"").alias("counts")).mapInArrow(_class_pairs(classes), "c int, d int, n long")
    for c, d, n in found.groupBy("c", "d").agg(F.sum("n")).collect():  # classes x classes numbers
        out[c, d] = n
    return out


def exchange_round(blocks: DataFrame, pairs: np.ndarray, buckets: int) -> DataFrame:
    """The blocks after all words have chosen against ``pairs``."""
    asked = blocks.drop("ids", "was", "words", "kinds", "once").mapInArrow(_neighbours(len(pairs), buckets), _ROW)
    answers = asked.groupBy("bucket").applyInArrow(_exchange(pairs), _ROW)
    return answers.groupBy("block").cogroup(blocks.drop("keys").withColumn("keys", F.lit(b"")).groupBy("block")).applyInArrow(_answered, blocks.schema)


def transitions(pairs: np.ndarray, n_tokens: int, once: int, kappa: float = KAPPA) -> np.ndarray:
    """log10 P(class d | class c); the last class is the unknown word's."""
    unknown = (once + 1) / (n_tokens + 2) if n_tokens else 1.0
    share = np.append((1 - unknown) * pairs.sum(0) / max(n_tokens, 1), unknown)
    seen = np.zeros((len(share), len(share)))
    seen[:-1, :-1] = pairs
    with np.errstate(divide="ignore"):
        return np.log10((seen + kappa * share) / (seen.sum(1, keepdims=True) + kappa))


def _score(log_moves: np.ndarray, class_size: np.ndarray, n_tokens: int, kinds: int):
    unknown = len(class_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                known = b.counts > 0
                cls = np.where(known, b.cls, unknown).astype(np.uint8)
                size = np.append(class_size, 1.0)[cls]
                emit = np.where(known, np.log10(np.maximum(b.counts, 1) / np.maximum(size, 1)), 0.0)
                base = np.log10((b.counts + 1.0) / (n_tokens + kinds + 1))
                begins, ids = np.concatenate([[0], b.ends[:-1]]), batch.column("ids")[i].values
                first = 0
                while first < len(b.ends):  # some whole documents at a time
                    last = max(first + 1, int(np.searchsorted(b.ends, begins[first] + PIECE, side="right")))
                    t, at = b.tokens[begins[first] : b.ends[last - 1]], begins[first:last] - begins[first]
                    c = cls[t]
                    # a text follows an end, and ends in one
                    move = log_moves[np.concatenate([c[-1:], c[:-1]]), c]
                    sums = [np.add.reduceat(x, at) for x in (known[t].astype(np.int64), base[t], emit[t] + move)]
                    cols = [ids.slice(first, last - first), pa.array(b.train[first:last]), pa.array(b.ends[first:last] - begins[first:last]), *map(pa.array, sums)]
                    yield pa.record_batch(cols, names=["id", "train", "n_tokens", "n_known", "base_score", "score"])
                    first = last

    return run


def scored(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, kappa: float = KAPPA, id_col: str = "doc_id", text_col: str = "text",
           folds: int = FOLDS, held_out: int = HELD_OUT, block_bytes: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score):
    the scores are log10 probabilities; ``10 ** (-score / n_tokens)`` is the
    perplexity."""
    blocks, pairs, n_tokens, kinds, once = trained(docs, classes, rounds, id_col, text_col, folds, held_out, block_bytes, bucket)
    kind = docs.schema[id_col].dataType.simpleString()
    score = _score(transitions(pairs, n_tokens, once, kappa), pairs.sum(0), n_tokens, kinds)
    out = blocks.drop("kinds", "once", "was").mapInArrow(score, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def trained(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
            folds: int = FOLDS, held_out: int = HELD_OUT, block_bytes: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, np.ndarray, int, int, int]:
    """(blocks, class pairs, training tokens, kinds of words in training, kinds
    seen once); the blocks hold every word's class and training count."""
    if not 2 <= classes <= 128 or rounds < 1:
        raise ValueError("classes must be 2 to 128 and rounds at least 1")
    kind = docs.schema[id_col].dataType
    train = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds != held_out
    texts = docs.select(F.col(id_col).alias("id"), train.alias("train"), text_of(text_col).alias("text"))
    schema = f"ids array<{kind.simpleString()}>, {_BLOCK}"
    blocks, path = write_cut(texts.mapInArrow(_blocks(to_arrow_type(kind), classes, block_bytes), schema), "class-lm-blocks")
    buckets = 1 + blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] // bucket
    pairs = _pairs(blocks, classes)
    for _ in range(rounds):
        step, done = write_cut(exchange_round(blocks, pairs, buckets), "class-lm-blocks")
        remove_path(docs.sparkSession, path)
        blocks, path, found = step, done, _pairs(step, classes)
        if likelihood(found) <= likelihood(pairs):
            blocks = blocks.withColumn("cls", F.col("was"))
            break
        pairs = found
    kinds, once = blocks.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    return blocks, pairs, int(pairs.sum()), kinds, once
