"""Exact removal of repeated byte strings by sorted suffixes.

Method.  A byte goes if a string of ``n`` bytes that covers it also starts
anywhere else.  Suffixes that can begin such a string (``repeats``: those of
stretches whose anchor gram stands elsewhere too) are range-partitioned by the
bytes they lead with at the anchor, with splitters that Spark samples.  Each
bucket sorts its suffixes by multikey quicksort, eight bytes a key: first by the
anchor's gram, then, where several remain, every string of ``n`` bytes.  Equal
neighbours repeat.  A lead that ends a bucket may go on in the next one.  The
strings of such a lead whose anchor lies in the same 31 places share all but 30
of their bytes: these cores are compared first, and only where another bucket
has the core too, every string of it, by a second, hashed shuffle.

Scale.  Texts are shuffled once, and once more those that have candidates;
anchors are about 1 in 76 bytes.  Copies of a text count as one text and are
settled by their number.  Equal stretches are one row a task; the members that
a task knows to repeat are spread evenly and meet no other.  Since splitters
fall inside a hot lead too (the key goes on with a hash of the stretch), its
rows lie in several buckets.

Defined cases.  A null text is empty; texts of under ``n`` bytes lose nothing
but what is said above.  Repeated rows are copies.  Ids take no part, so they
may be null or repeated.  Of the input only the columns named are used;
``remove_repeats`` returns all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrid.llm import repeats as R
from jobgrid.llm.arrow import lean, slices, values
from jobgrid.llm.frames import free_name, small_batches, store, text_of

BYTES, GRAM, LEAD = 200, 50, 16
#: places of the anchor in a string that have one core
PLACES = 31
#: stretches of about this many bytes in a bucket, windows compared at a time, and bytes of cores
#: whose strings are
BUCKET_BYTES, WINDOWS, CORE_BYTES = 4 << 20, 1 << 18, 1 << 19
_ONCE, _KNOWN, _NOTE = 0, 1, 2
#: strings of a bucket's first or last lead that share a core; plus 1 if the bucket holds them
#: more than once
_CORE = 4
_STRINGS = "kind int, t1 long, t2 long, s long, e long, w1 long, w2 long"
_COMPARED = _STRINGS + ", body binary"


def multikey_classes(blob: np.ndarray, starts: np.ndarray, length: int, classes: np.ndarray) -> np.ndarray:
    """Numbers that are equal for suffixes of the same class whose first
    ``length`` bytes are equal.  Multikey quicksort with keys of eight bytes:
    a class is partitioned by one key at a time, and only parts of two or more
    suffixes go on to the next."""
    windows = np.lib.stride_tricks.sliding_window_view(blob, 8)
    order = np.argsort(classes, kind="stable")
    begins = np.ones(len(order), bool)  # whether a class begins at a place in the order
    begins[1:] = classes[order][1:] != classes[order][:-1]
    live = np.arange(len(order))
    for depth in [*range(0, length - 8, 8), length - 8]:
        ends = np.append(begins[1:], True)
        live = live[~(begins[live] & ends[live])]  # classes of one suffix are done
        if not len(live):
            break
        key = windows[starts[order[live]] + depth].view(">u8").ravel()
        first = begins[live]
        mine = np.cumsum(first) - 1
        split = np.zeros(mine[-1] + 1, bool)
        split[mine[key != key[first][mine]]] = True
        part = np.nonzero(split[mine])[0]
        if len(part):
            by = part[np.lexsort((key[part], mine[part]))]  # each class keeps its places
            order[live[part]] = order[live[by]]
            begins[live[part][1:]] |= (key[by][1:] != key[by][:-1]) & (mine[by][1:] == mine[by][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(begins) - 1
    return out


def _stretch_rows(n: int):
    """Rows of the candidate stretches; equal ones of a task are one row."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in R.few_inflated(batches):
            texts = R.inflated(batch.column("z"))
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            seen: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
            for i, places in enumerate(batch.column("places")):
                text, places = texts[i], places.values.to_numpy()
                for p, a, b, c in zip(places.tolist(), *(x.tolist() for x in R.unpacked(places))):
                    seen.setdefault((text[a : b + n], c - a), []).append((i, p))
            rows = []
            for (body, off), members in seen.items():
                lead, salt = body[off : off + LEAD], xxh64_intdigest(body) >> 1
                if len(members) > 1:
                    rows.append((lead, salt, _NOTE, body, 0, 0, off))
                    rows.extend((int(t1[i] ^ p).to_bytes(16, "little", signed=True), 0, _KNOWN, b"", t1[i], t2[i], p) for i, p in members)
                else:
                    ((i, p),) = members
                    rows.append((lead, salt, _ONCE, body, t1[i], t2[i], p))
            if rows:
                types = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), *(pa.int64(),) * 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lead", "salt", "kind", "body", "t1", "t2", "place"]
                )

    return lean(run), "lead binary, salt long, kind int, body binary, t1 long, t2 long, place long"


def _rows(kind, t1, t2, s, e, w1=None, w2=None) -> pa.RecordBatch:
    none = np.zeros(len(t1), np.int64)
    cols = [np.full(len(t1), kind, np.int32), t1, t2, s, e, none if w1 is None else w1, none if w2 is None else w2]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "t1", "t2", "s", "e", "w1", "w2"])


def _with_body(rows: pa.RecordBatch, body: list[bytes] | None = None) -> pa.RecordBatch:
    return rows.append_column("body", pa.nulls(rows.num_rows, pa.binary()) if body is None else pa.array(body, pa.binary()))


def _window_hashes(blob: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    items = R.byte_items(blob)
    return tuple(R.gram_hashes(x, n)[starts].view(np.int64) for x in (items, R.mix(items)))  # type: ignore[return-value]


def _compare(n: int, k: int):
    """One bucket: intervals of repeated bytes, and the strings of its first
    and last lead, by cores, for the comparison across boundaries."""

    def run(batches):
        rep: dict[tuple[bytes, int], int] = {}
        body, off, many, t1, t2, first = [], [], [], [], [], []
        for batch in batches:
            kind, place, a, b = (batch.column(c).to_numpy() for c in ("kind", "place", "t1", "t2"))
            known = kind == _KNOWN
            if known.any():
                s, e, _ = R.unpacked(place[known])
                yield _with_body(_rows(_KNOWN, a[known], b[known], s, e + n))
            s, e, anchor = R.unpacked(place)
            offset = np.where(kind == _NOTE, place, anchor - s)
            again, bodies = [], values(batch.column("body"))
            for i in np.nonzero(~known)[0].tolist():
                key = (bodies[i], int(offset[i]))
                r = rep.setdefault(key, len(body))
                if r == len(body):
                    body.append(key[0]), off.append(key[1]), many.append(kind[i] == _NOTE)
                    t1.append(a[i]), t2.append(b[i]), first.append(s[i])
                    continue
                if not many[r]:  # its first member is settled now
                    many[r] = True
                    again.append((t1[r], t2[r], first[r], first[r] + len(key[0])))
                if kind[i] == _ONCE:
                    again.append((a[i], b[i], s[i], s[i] + len(key[0])))
            if again:
                yield _with_body(_rows(_KNOWN, *(np.array(c, np.int64) for c in zip(*again))))
        rep.clear()
        if not body:
            return
        off, many, t1, t2, first = np.array(off), np.array(many), *(np.array(x, np.int64) for x in (t1, t2, first))
        size = np.fromiter(map(len, body), np.int64, len(body))
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        leads = [x[o : o + LEAD] for x, o in zip(body, off.tolist())]
        low, high = min(leads), max(leads)
        edge = [i for i, x in enumerate(leads) if x == low or x == high]
        for part in range(0, len(edge), 10_000):
            yield from _core_rows(edge[part : part + 10_000], body, off, many, t1, t2, first, n, k)
        blob = np.frombuffer(b"".join(body), np.uint8)
        del body, leads
        gram = multikey_classes(blob, base + off, k, np.zeros(len(off), np.int64))
        active = np.nonzero(np.bincount(gram)[gram] > 1)[0]
        count = size - n + 1
        blocks = int(count[active].sum() // WINDOWS) + 1
        found = []
        step = -(-(n - k + 1) // blocks)
        for o in range(0, n - k + 1, step):  # windows whose anchor is o to o + step - 1 in
            lo = np.maximum(0, off[active] - (o + step - 1))
            here = np.maximum(0, np.minimum(count[active] - 1, off[active] - o) - lo + 1)
            who = np.repeat(active, here)
            j = np.arange(len(who)) - np.repeat(np.cumsum(here) - here - lo, here)
            label = multikey_classes(blob, base[who] + j, n, gram[who] * n + off[who] - j)
            repeats = np.bincount(label, np.where(many[who], 2, 1))[label] > 1 if len(label) else np.zeros(0, bool)
            mine = repeats & ~many[who]
            found.append(who[mine] * n + j[mine])
        hits = np.sort(np.concatenate(found))
        if len(hits):
            yield _with_body(_hit_rows(hits, t1, t2, first, n))

    return lean(run)


def _hit_rows(hits, t1, t2, first, n) -> pa.RecordBatch:
    """Intervals of the strings ``hits`` (stretch * n + place in it, sorted);
    strings in a row are one interval."""
    new = np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (hits[1:] // n != hits[:-1] // n)])
    who, begin, end = hits[new] // n, hits[new] % n, np.append(hits[:-1][new[1:]], hits[-1]) % n
    return _rows(_KNOWN, t1[who], t2[who], first[who] + begin, first[who] + end + n)


def _core_rows(edge, body, off, many, t1, t2, first, n, k):
    """Bytes that hold the strings of one core: ``w1`` is a hash of the core,
    ``w2`` the bucket."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    kind, who, start, key, part = [], [], [], [], []
    for i in edge:
        x, o = body[i], int(off[i])
        for least in range(max(0, o - len(x) + n) // PLACES * PLACES, min(n - k, o) + 1, PLACES):
            most = min(least + PLACES - 1, n - k)  # places of the anchor in a string
            begin = max(0, o - most)
            kind.append(_CORE + bool(many[i])), who.append(i), start.append(begin)
            key.append(xxh64_intdigest(x[o - least : o - most + n], least) >> 1), part.append(x[begin : o - least + n])
    at, begin = np.array(who, np.int64), np.array(start, np.int64)
    bucket = np.full(len(at), TaskContext.get().partitionId(), np.int64)
    rows = _rows(_CORE, t1[at], t2[at], first[at] + begin, np.zeros(len(at), np.int64), np.array(key, np.int64), bucket)
    yield _with_body(rows, part).set_column(0, "kind", pa.array(kind, pa.int32()))


def _core_strings(n: int):
    """The strings of ``n`` bytes of the rows of cores: intervals of those that
    repeat in a batch, a note of each of these, and the others."""

    def run(batches):
        for batch in slices(batches, "body", CORE_BYTES):
            kind, t1, t2, first = (batch.column(c).to_numpy() for c in ("kind", "t1", "t2", "s"))
            body, many = values(batch.column("body")), kind > _CORE
            size = np.fromiter(map(len, body), np.int64, len(body))
            base = np.concatenate([[0], np.cumsum(size)[:-1]])
            here = size - n + 1
            who = np.repeat(np.arange(len(body)), here)
            j = np.arange(len(who)) - np.repeat(np.cumsum(here) - here, here)
            w1, w2 = _window_hashes(np.frombuffer(b"".join(body), np.uint8), base[who] + j, n)
            order = np.lexsort((w2, w1))
            new = np.concatenate([[True], (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])])
            label = np.empty(len(order), np.int64)
            label[order] = np.cumsum(new) - 1
            repeats = np.bincount(label, np.where(many[who], 2, 1))[label] > 1
            note = order[new][repeats[order[new]]]
            none = np.zeros(len(note), np.int64)
            yield _rows(_NOTE, none, none, none, none, w1[note], w2[note])
            once = ~repeats
            s = first[who[once]] + j[once]
            yield _rows(_ONCE, t1[who[once]], t2[who[once]], s, s + n, w1[once], w2[once])
            mine = repeats & ~many[who]
            if mine.any():
                yield _hit_rows(np.sort(who[mine] * n + j[mine]), t1, t2, first, n)

    return lean(run)


def repeated_intervals(held: DataFrame, n: int = BYTES, k: int = GRAM) -> DataFrame:
    """(t1, t2, s, e): byte intervals that cover what repeats, from the texts
    with candidate stretches (``repeats.with_candidates``)."""
    spark = held.sparkSession
    stretches = held.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(stretches * 1.5 * n) // BUCKET_BYTES + 1)
    rows, schema = _stretch_rows(n)
    with small_batches(spark):
        bucketed = held.mapInArrow(rows, schema).repartitionByRange(buckets, "lead", "salt")
        compared = store(bucketed.mapInArrow(_compare(n, k), _COMPARED), "suffix-buckets")
    cores = compared.filter(F.col("kind") >= _CORE)
    shared = cores.groupBy("w1").agg(F.min("w2").alias("b1"), F.max("w2").alias("b2")).filter("b1 < b2").select("w1")
    strings = store(cores.join(shared, "w1").mapInArrow(_core_strings(n), _STRINGS), "suffix-cores")
    edges = strings.filter(F.col("kind") != _KNOWN)
    # a note of a batch stands for two places or more
    common = edges.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    across = edges.filter(F.col("kind") == _ONCE).join(common, ["w1", "w2"])
    cols = ("t1", "t2", "s", "e")
    known = [x.filter(F.col("kind") == _KNOWN).select(*cols) for x in (compared, strings)]
    return known[0].union(known[1]).union(across.select(*cols))


def cut_texts(docs: DataFrame, text_col: str = "text", n: int = BYTES, k: int = GRAM) -> DataFrame:
    """(t1, t2, starts, ends, kept, kept_text) of every text that loses bytes
    to other places: the maximal removed runs, the bytes that stay, and the
    characters that lose none of their bytes."""
    text = text_of(text_col)
    held = R.with_candidates(docs.select(*R.text_key(text), text.alias("text")), R.byte_items, n, k)
    spans = repeated_intervals(held, n, k).groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in R.few_inflated(batches):
            starts, ends, kept, whole = [], [], [], []
            for text, spans in zip(R.inflated(b.column("z")), b.column("spans")):
                s, e = R.merged(*(spans.values.field(x).to_numpy() for x in ("s", "e")))
                text = np.frombuffer(text, np.uint8)
                stay = np.ones(len(text), bool)
                for x, y in zip(s.tolist(), e.tolist()):
                    stay[x:y] = False
                char = np.cumsum((text & 0xC0) != 0x80) - 1
                hurt = np.zeros(char[-1] + 1, bool)
                hurt[char[~stay]] = True
                starts.append(s), ends.append(e), kept.append(text[stay].tobytes()), whole.append(text[~hurt[char]].tobytes().decode())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("t1"), b.column("t2"), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary()), pa.array(whole, pa.string())],
                names=["t1", "t2", "starts", "ends", "kept", "kept_text"],
            )

    schema = "t1 long, t2 long, starts array<long>, ends array<long>, kept binary, kept_text string"
    return held.select("t1", "t2", "z").join(spans, ["t1", "t2"]).mapInArrow(lean(cut), schema)


def copied_texts(docs: DataFrame, text_col: str = "text", n: int = BYTES) -> DataFrame:
    """(t1, t2, copies) of the texts of ``n`` bytes or more that several rows
    have: they lose all bytes, in one run."""
    text = text_of(text_col)
    long = docs.select(*R.text_key(text), F.octet_length(text).alias("size")).filter(F.col("size") >= n)
    return long.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def remove_repeats(docs: DataFrame, text_col: str = "text", n: int = BYTES, k: int = GRAM) -> DataFrame:
    """``docs`` without the repeated bytes of ``text_col``; a character that
    loses some of its bytes goes whole.  Null texts stay null."""
    t1, t2, copies, kept = (free_name(docs, f"repeat_{x}") for x in ("t1", "t2", "copies", "kept"))
    cut = cut_texts(docs, text_col, n, k).select("t1", "t2", "kept_text").toDF(t1, t2, kept)
    keys = R.text_key(text_of(text_col))
    joined = docs.withColumns({t1: keys[0], t2: keys[1]}).join(copied_texts(docs, text_col, n).toDF(t1, t2, copies), [t1, t2], "left").join(cut, [t1, t2], "left")
    left = F.when(F.col(copies).isNotNull(), F.lit("")).otherwise(F.coalesce(kept, F.col(f"`{text_col}`")))
    return joined.select(*(left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
