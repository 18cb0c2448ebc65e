"""Where windows of ``n`` consecutive items (bytes, words) may repeat.

Every window has one anchor: its gram of ``k`` items with the least hash, the
leftmost of equals.  That depends on the window's content alone, so equal
windows have equal anchors at equal places.  Windows in a row mostly share an
anchor and form a *stretch*; a text has about ``2 / (n - k + 2)`` stretches an
item.  Only stretches whose anchor gram also stands elsewhere can hold a
repeated window; they alone are carried on with their items.

Texts are told apart by two 64-bit hashes (t1, t2), so copies of a text are one
text from the start, and a task drops what it already holds before a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrid.llm.arrow import lean, slices, utf8, values
from jobgrid.llm.frames import small_batches, store

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: items worked on at a time, beside the windows that reach over the end
BLOCK = 1 << 18
#: bytes of texts whose anchors a task compares before they are shuffled, and of compressed texts it
#: holds inflated
TEXT_BYTES, DEFLATED_BYTES = 4 << 20, 1 << 20
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if not _power or len(_power[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        both = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in both:
            p[0] = 1
        _power[:] = [np.cumprod(p) for p in both]
    return _power[0], _power[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _prefix(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position."""
    sums = _prefix(values)
    n = len(values) - k + 1
    return mix((sums[k:] - sums[:n]) * _powers(n)[1][:n])


def byte_items(text: np.ndarray) -> np.ndarray:
    return _BYTE[text]


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII blanks."""
    blank = np.concatenate([[True], (text == 32) | ((text >= 9) & (text <= 13)), [True]])
    edges = np.nonzero(blank[1:] != blank[:-1])[0]
    return edges[::2], edges[1::2]


def word_items(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, made block by block."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not (text[end] == 32 or 9 <= text[end] <= 13):
            end += 1
        part = text[at:end]
        start, stop = word_bounds(part)
        sums = _prefix(_BYTE[part])
        out.append(mix((sums[stop] - sums[start]) * _powers(len(part))[1][start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def stretches(values: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's gram hash) of each stretch
    of one text's items, in order."""
    found = []
    for begin in range(0, len(values) - n + 1, BLOCK):
        part = values[begin : begin + BLOCK + n - 1]
        grams = gram_hashes(part, k)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, want = 1, n - k + 1
        while 2 * width <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        found.append((first + begin, last + begin, anchor[first] + begin, grams[anchor[first]]))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that tell texts apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _packed(first, last, anchor):
    return first << 20 | (anchor - first) << 10 | (last - first)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 20
    return first, first + (place & 1023), first + (place >> 10 & 1023)


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, whether a row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


#: kinds of anchor rows: of a gram seen once in its task; of one known to
#: repeat; a note that a gram repeats
_ONCE, _KNOWN, _NOTE = 0, 1, 2


def _anchors(items: Callable[[np.ndarray], np.ndarray], n: int, k: int):
    def run(batches):
        for batch in slices(batches, "text", TEXT_BYTES):
            at, data = utf8(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("t1", "t2")]
            rows = []
            for i in range(batch.num_rows):
                if at[i + 1] - at[i] >= n:
                    first, last, anchor, h = stretches(items(data[at[i] : at[i + 1]]), n, k)
                    if len(first):
                        rows.append((h.view(np.int64), np.full(len(h), keys[0][i]), np.full(len(h), keys[1][i]), _packed(first, last, anchor)))
            if not rows:
                continue
            h, t1, t2, place = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((place, t2, t1, h))
            order = order[~_same_as_before(h[order], t1[order], t2[order], place[order])]  # copies of a text
            h, t1, t2, place = h[order], t1[order], t2[order], place[order]
            again = _same_as_before(h)
            repeats = again | np.append(again[1:], False)
            note = h[repeats & ~again]
            none = np.zeros(len(note), np.int64)
            # known ones need not meet the others of their gram: they are spread
            yield pa.RecordBatch.from_pydict({
                "route": np.concatenate([np.where(repeats, t1 + place, h), note]), "h": np.concatenate([h, note]),
                "kind": np.concatenate([np.where(repeats, _KNOWN, _ONCE), none + _NOTE]).astype(np.int32),
                "t1": np.concatenate([t1, none]), "t2": np.concatenate([t2, none]), "place": np.concatenate([place, none]),
            })

    return lean(run)


def _repeating(batches):
    """Anchors whose gram repeats, from rows sorted by (kind is known, h, text,
    place); a gram's rows may go on over batches of any number."""
    names = ("t1", "t2", "place")
    gram, pending, shown = None, None, False  # open gram, its only row so far, whether it repeats
    for batch in batches:
        c = {x: batch.column(x).to_numpy() for x in ("h", "kind", *names)}
        known = c["kind"] == _KNOWN
        if known.any():
            yield pa.RecordBatch.from_pydict({x: c[x][known] for x in names})
        c = {x: v[~known] for x, v in c.items()}
        if not len(c["h"]):
            continue
        if pending is not None:
            c = {x: np.concatenate([[pending[x]], v]).astype(v.dtype) for x, v in c.items()}
            pending = None
        keep = ~_same_as_before(c["h"], c["t1"], c["t2"], c["place"], c["kind"])
        c = {x: v[keep] for x, v in c.items()}
        h = c["h"]
        again = _same_as_before(h)
        group = np.cumsum(~again) - 1
        many = np.bincount(group) > 1
        many |= np.bincount(group, c["kind"] == _NOTE) > 0
        if gram is not None and h[0] == gram:
            many[0] |= shown
        gram, shown = h[-1], bool(many[-1])
        if not shown:
            pending = {x: v[-1] for x, v in c.items()}
        out = many[group] & (c["kind"] == _ONCE)
        yield pa.RecordBatch.from_pydict({x: c[x][out] for x in names})


def candidates(texts: DataFrame, items: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> DataFrame:
    """(t1, t2, places) of the texts (t1, t2, text; copies allowed) that have
    stretches whose anchor gram stands in another place too."""
    anchors = texts.mapInArrow(_anchors(items, n, k), "route long, h long, kind int, t1 long, t2 long, place long")
    met = anchors.repartition("route").sortWithinPartitions(F.col("kind") != _KNOWN, "h", "t1", "t2", "place", "kind")
    found = met.drop("route").mapInArrow(lean(_repeating), "t1 long, t2 long, place long")
    return found.groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))


def deflated(text: Column) -> Column:
    """The text's bytes compressed, to be shuffled."""

    @F.arrow_udf("binary")
    def deflate(texts: pa.Array) -> pa.Array:
        at, data = utf8(texts)
        raw, at, one = memoryview(data), at.tolist(), zstandard.ZstdCompressor(level=3)
        return pa.array([one.compress(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary())

    return deflate(text)


def inflated(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, values(column)))


def few_inflated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts (z) may be held ``inflated`` at once."""
    return slices(batches, "z", DEFLATED_BYTES)


def one_of_each(texts: DataFrame, order: str = "t1") -> DataFrame:
    """One row of each text, that with the least ``order``; copies go before
    the shuffle as far as a task sees them."""
    w = W.partitionBy("t1", "t2").orderBy(order)
    return texts.withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy")


def with_candidates(texts: DataFrame, items: Callable[[np.ndarray], np.ndarray], n: int, k: int, order: str = "t1") -> DataFrame:
    """The texts that have candidate stretches, once each and ``deflated`` (z),
    with their ``places``: a stored table."""
    small = texts.select(*(c for c in texts.columns if c != "text"), deflated(F.col("text")).alias("z"))
    with small_batches(texts.sparkSession):
        return store(one_of_each(small, order).join(candidates(texts, items, n, k), ["t1", "t2"]), "repeat-texts")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by the intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], np.append(ends[:-1][first[1:]], ends[-1])
