"""Removal of passages that an earlier document has, by repeated-phrase
automata.

Method.  A window is ``n`` consecutive words.  Words covered by a window that
also starts in a document with a smaller id go.  Stretches of text that can
hold a recurring window (``repeats``, over word hashes) are dealt to shards by
their anchor gram.  A shard confirms which windows recur in other stretches,
joins windows in a row that recur in the same stretches to one phrase, compiles
the phrases to Aho-Corasick automata of bounded size and streams its stretches
through them to locate every occurrence; an occurrence goes if another one is
in a smaller document.

Scale.  As for ``suffix_dedup``: texts are shuffled once, and once more those
with candidates; copies count as one text, the smallest id; equal stretches
are one row a task, members known to go are spread evenly.  Shards are ranges
of (gram, hash of the stretch), so a hot gram lies in several; windows of the
first and last gram of a shard are compared across shards by a hashed shuffle.

Defined cases.  A null text has no words.  A null id counts as greater than
all.  Repeated rows with one id do not take from each other.  Words are
compared by 64-bit hashes, 50 in a row.  Of the input only the id and text
columns are used.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.llm import repeats as R
from jobgrid.llm.arrow import values
from jobgrid.llm.frames import store, text_of

WORDS, GRAM = 50, 8
#: bytes of stretches in a shard, and windows looked at with one automaton
SHARD_BYTES, WINDOWS = 16 << 20, 100_000
LAST = (1 << 63) - 1
_ONCE, _KNOWN = 0, 1
_LOCATED = "kind int, d long, t1 long, t2 long, s long, e long, w1 long, w2 long"


def rank_of(id_col: str) -> Column:
    """Order of the documents; those without an id come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def _stretch_rows(n: int):
    """Rows of the candidate stretches; of equal ones in a task only that of
    the smallest document keeps its words."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = R.inflated(batch.column("z"))
            d, t1, t2 = (batch.column(c).to_numpy() for c in ("d", "t1", "t2"))
            seen: dict[tuple[bytes, int], list[tuple[int, int]]] = defaultdict(list)
            for i, places in enumerate(batch.column("places")):
                words = R.word_items(np.frombuffer(texts[i], np.uint8))
                places = places.values.to_numpy()
                for p, a, b, c in zip(places.tolist(), *(x.tolist() for x in R.unpacked(places))):
                    seen[words[a : b + n].tobytes(), c - a].append((i, p))
            rows = []
            for (body, off), members in seen.items():
                salt = xxh64_intdigest(body) >> 1
                lead = xxh64_intdigest(body[8 * off : 8 * (off + GRAM)]) >> 1
                least = min(d[i] for i, _ in members)
                for i, p in members:
                    if d[i] == least:
                        rows.append((lead, salt, _ONCE, body, d[i], t1[i], t2[i], p))
                    else:
                        rows.append(((int(t1[i]) ^ p) >> 1, 0, _KNOWN, b"", d[i], t1[i], t2[i], p))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), *(pa.int64(),) * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lead", "salt", "kind", "body", "d", "t1", "t2", "place"]
                )

    return run, "lead long, salt long, kind int, body binary, d long, t1 long, t2 long, place long"


def _rows(kind, d, t1, t2, s, e, w1=None, w2=None) -> pa.RecordBatch:
    none = np.zeros(len(t1), np.int64)
    cols = [np.full(len(t1), kind, np.int32), d, t1, t2, s, e, none if w1 is None else w1, none if w2 is None else w2]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "d", "t1", "t2", "s", "e", "w1", "w2"])


def _longs(rows: list[tuple]) -> list[np.ndarray]:
    return list(np.array(rows, np.int64).reshape(-1, 5).T)


def _phrases(words: np.ndarray, who: np.ndarray, j: np.ndarray, at: np.ndarray, d: np.ndarray, label: np.ndarray, n: int) -> dict[bytes, int]:
    """Recurring phrases (as bytes of word numbers) and their lengths.  A
    window recurs if stretches of two documents have it; windows in a row with
    the same set of stretches are one phrase."""
    classes = int(label.max()) + 1
    low, high = np.full(classes, LAST), np.full(classes, -LAST - 1)
    np.minimum.at(low, label, d[who])
    np.maximum.at(high, label, d[who])
    group = np.zeros(classes, np.uint64)
    np.add.at(group, label, R.mix(who.astype(np.uint64) + np.uint64(1)))
    hit = np.nonzero((low < high)[label])[0]
    if not len(hit):
        return {}
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (who[hit[1:]] != who[hit[:-1]]) | (group[label[hit[1:]]] != group[label[hit[:-1]]])
    begin, end = hit[new], np.append(hit[:-1][new[1:]], hit[-1])
    out = {}
    for s, e in zip((at[who[begin]] + j[begin]).tolist(), (at[who[end]] + j[end] + n).tolist()):
        out[words[s:e].tobytes()] = e - s
    return out


def _locate(bodies: list[np.ndarray], d: np.ndarray, edge: np.ndarray, n: int):
    """Of some stretches: (stretch, first word, end) of the phrases that go,
    and (stretch, window, hashes) of the edge windows that stay so far."""
    import ahocorasick

    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    at = np.concatenate([[0], np.cumsum(size)])
    items = np.concatenate(bodies)
    count = size - n + 1
    who = np.repeat(np.arange(len(bodies)), count)
    j = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    w1 = R.gram_hashes(items, n)[at[who] + j]
    label = np.unique(w1, return_inverse=True)[1]
    words = np.unique(items, return_inverse=True)[1].astype(np.int64)
    phrases = _phrases(words, who, j, at, d, label, n)
    gone = []
    if phrases:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, (phrase, length) in enumerate(phrases.items()):
            automaton.add_word(tuple(np.frombuffer(phrase, np.int64).tolist()), (number, length))
        automaton.make_automaton()
        places = [(p, i, end + 1 - length, end + 1) for i in range(len(bodies)) for end, (p, length) in automaton.iter(tuple(words[at[i] : at[i + 1]].tolist()))]
        p, i, s, e = np.array(places, np.int64).T
        least = np.full(len(phrases), LAST)
        np.minimum.at(least, p, d[i])
        later = d[i] > least[p]
        gone = list(zip(i[later].tolist(), s[later].tolist(), e[later].tolist()))
    keep = np.zeros((0, 4), np.int64)
    if edge.any():
        low = np.full(int(label.max()) + 1, LAST)
        np.minimum.at(low, label, d[who])
        stay = edge[who] & (d[who] == low[label])
        w2 = R.gram_hashes(R.mix(items), n)[at[who] + j]
        keep = np.stack([who[stay], j[stay], w1.view(np.int64)[stay], w2.view(np.int64)[stay]], axis=1)
    return gone, keep


def _search(n: int):
    """One shard: intervals of words that go, and the windows of its first and
    last gram for the comparison across shards."""

    def run(batches):
        reps: dict[tuple[bytes, int], list[tuple]] = {}  # members with the least id
        lead_of: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            kind, place, lead, d, t1, t2 = (batch.column(c).to_numpy() for c in ("kind", "place", "lead", "d", "t1", "t2"))
            s, e, anchor = R.unpacked(place)
            known = kind == _KNOWN
            if known.any():
                yield _rows(_KNOWN, d[known], t1[known], t2[known], s[known], e[known] + n)
            bodies, gone = values(batch.column("body")), []
            for i in np.nonzero(~known)[0].tolist():
                key = (bodies[i], int(anchor[i] - s[i]))
                me = (int(d[i]), int(t1[i]), int(t2[i]), int(s[i]), int(e[i]) + n)
                mine = reps.setdefault(key, [])
                if mine and me[0] > mine[0][0]:
                    gone.append(me)
                    continue
                if mine and me[0] < mine[0][0]:
                    gone.extend(mine)
                    mine.clear()
                mine.append(me)
                lead_of[key] = int(lead[i])
            if gone:
                yield _rows(_KNOWN, *_longs(gone))
        if not reps:
            return
        by_lead = defaultdict(list)
        for key, lead in lead_of.items():
            by_lead[lead].append(key)
        ends = {min(by_lead), max(by_lead)}
        open_keys: list[tuple[bytes, int]] = []
        windows = 0
        for number, lead in enumerate(sorted(by_lead)):
            keys = by_lead[lead]
            if len(keys) > 1 or lead in ends:
                open_keys += keys
                windows += sum(len(b) // 8 - n + 1 for b, _ in keys)
            if open_keys and (windows >= WINDOWS or number == len(by_lead) - 1):
                bodies = [np.frombuffer(b, np.uint64) for b, _ in open_keys]
                d = np.array([reps[key][0][0] for key in open_keys], np.int64)
                edge = np.array([lead_of[key] in ends for key in open_keys])
                gone, keep = _locate(bodies, d, edge, n)
                rows = [(m[0], m[1], m[2], m[3] + s, m[3] + e) for i, s, e in gone for m in reps[open_keys[i]]]
                if rows:
                    yield _rows(_KNOWN, *_longs(rows))
                rows = [(m[0], m[1], m[2], m[3] + j, m[3] + j + n, w1, w2) for i, j, w1, w2 in keep.tolist() for m in reps[open_keys[i]]]
                if rows:
                    yield _rows(_ONCE, *np.array(rows, np.int64).T)
                open_keys, windows = [], 0

    return run


def passages_to_remove(held: DataFrame, n: int = WORDS) -> DataFrame:
    """(t1, t2, s, e): intervals of words that an earlier document has, from
    the texts with candidate stretches and their rank ``d``."""
    spark = held.sparkSession
    stretches = held.agg(F.sum(F.size("places"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(stretches * 12 * n) // SHARD_BYTES + 1)
    rows, schema = _stretch_rows(n)
    dealt = held.mapInArrow(rows, schema).repartitionByRange(shards, "lead", "salt")
    located = store(dealt.mapInArrow(_search(n), _LOCATED), "phrase-shards")
    edges = located.filter(F.col("kind") == _ONCE)
    least = edges.groupBy("w1", "w2").agg(F.min("d").alias("least"))
    across = edges.join(least, ["w1", "w2"]).filter("d > least")
    cols = ("t1", "t2", "s", "e")
    return located.filter(F.col("kind") == _KNOWN).select(*cols).union(across.select(*cols))


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, k: int = GRAM) -> DataFrame:
    """(t1, t2, removed, kept) of every text that loses words in the document
    of the smallest id that has it: their number, and the words that stay,
    joined by one space."""
    text = text_of(text_col)
    texts = docs.select(*R.text_key(text), text.alias("text"), rank_of(id_col).alias("d"))
    held = R.with_candidates(texts, R.word_items, n, k, "d")
    spans = passages_to_remove(held, n).groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in batches:
            removed, kept = [], []
            for text, spans in zip(R.inflated(b.column("z")), b.column("spans")):
                words = text.split()
                s, e = R.merged(*(spans.values.field(x).to_numpy() for x in ("s", "e")))
                bounds = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(words)]
                stay = [w for x, y in zip(bounds[::2], bounds[1::2]) for w in words[x:y]]
                removed.append(len(words) - len(stay)), kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("t1"), b.column("t2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["t1", "t2", "removed", "kept"]
            )

    return held.select("t1", "t2", "z").join(spans, ["t1", "t2"]).mapInArrow(cut, "t1 long, t2 long, removed long, kept string")


def copied_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t1, t2, least): texts of several rows and the rank of the first."""
    rows = docs.select(*R.text_key(text_of(text_col)), rank_of(id_col).alias("d"))
    return rows.groupBy("t1", "t2").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")


def joined_words(text: Column) -> Column:
    """Struct of the number of words and the words joined by one space."""
    kind = pa.struct([("n", pa.int64()), ("joined", pa.string())])

    @F.arrow_udf("struct<n: long, joined: string>")
    def join(texts: pa.Array) -> pa.Array:
        n, joined = [], []
        for t in values(texts):  # the words of one text at a time, not of the whole batch
            words = t.split()
            n.append(len(words)), joined.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(joined, pa.string())], fields=list(kind))

    return join(text)
