"""Ranked lexical search by NRA: sequential reads of impact-sorted postings,
with no random access to scores.

Method.  A term's weight is ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
a document's length norm ``m = 100 - 50 + ((50 * n * N) div L)``; a posting is
worth ``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` (whole numbers).  The
postings of a query's terms are read in falling order of worth, some of every
list at a time.  What was read is a document's lower bound; with the next worth
of each list it is not yet seen in, that is its upper bound.  Reading goes on
until no document outside the answer can reach it, ties included, and every
document in it has equal bounds, so that scores are final and exact.

Scale.  Texts are read once: each task cuts its documents into segments of at
most ``SEGMENT`` bytes of text and writes, for each, a small inverted index of
the queries' terms (term, document, occurrences).  N, L and df are sums over
segments, added up inside tasks first.  NRA then runs segment by segment; a
task keeps its own best ``k`` of each query, whose least score lets the next
segment stop early, and sends at most ``k`` rows a query.  A query's true best
are among its tasks' best.  A term in a third of all documents is spread over
all segments.  Queries are taken in blocks of ``BLOCK`` items, each with one
pass over the texts; the driver holds a block's terms and their df.

Defined cases.  A null or empty text (or one without a term) counts neither in
N nor in L and is never found.  A query without terms, or whose terms stand
nowhere, gets no rows.  Repeated rows, of either table, are ranked each.  Equal
scores go by ascending id, a null id first.  Empty tables give no rows.  Of the
inputs only the named columns are used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobgrid.llm.arrow import slices, values
from jobgrid.llm.frames import text_of
from jobgrid.session import cut_lineage

#: answers a query
K = 50
#: bytes of text in a segment (a longer document is a segment of its own)
SEGMENT = 16 << 20
#: queries that share a pass over the texts
BLOCK = 1000
#: postings of a list read in the first round; doubled in each round
FIRST_READ = 32

# Fixed values of the score.
SCALE, TF, NORM, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50, 50

#: bytes that no term holds become blanks, A-Z become small; bytes over 7F stay
_TERMS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of
    characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _index(vocabulary: dict[bytes, int], ids: pa.DataType, segment: int):
    """Documents (id, text) to segments: ids, lengths in terms, and postings
    by term, documents in falling order of occurrences."""
    schema = pa.schema([("ids", pa.list_(ids)), ("lengths", pa.binary()), ("term", pa.binary()), ("doc", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def made(doc_ids: list, lengths: list, term: list, doc: list, tf: list) -> pa.RecordBatch:
        t, d, f = (np.array(x, np.int32) for x in (term, doc, tf))
        order = np.lexsort((d, t))
        found = [pa.array([x[order].tobytes()], pa.binary()) for x in (t, d, f)]
        n = np.array(lengths, np.int64)
        return pa.record_batch([pa.array([doc_ids], pa.list_(ids)), pa.array([n.tobytes()], pa.binary()), *found, pa.array([len(n)]), pa.array([int(n.sum())])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        state: tuple = ([], [], [], [], [])
        held = 0
        for batch in slices(batches, "text"):
            doc_ids, lengths, term, doc, tf = state
            for key, text in zip(batch.column("id").to_pylist(), values(batch.column("text"))):
                found = terms(text)
                if not found:
                    continue
                at = len(lengths)
                doc_ids.append(key)
                lengths.append(len(found))
                counts = Counter(map(get, found))
                counts.pop(None, None)
                term.extend(counts)
                tf.extend(counts.values())
                doc.extend([at] * len(counts))
                held += len(text)
                if held >= segment:
                    yield made(*state)
                    state, held = ([], [], [], [], []), 0
                    doc_ids, lengths, term, doc, tf = state
        if state[1]:
            yield made(*state)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) over all segments of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in values(batch.column("term")):
            n = np.bincount(np.frombuffer(raw, np.int32), minlength=len(total))
            n[: len(total)] += total
            total = n
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])


def length_norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(lengths) and int(lengths.max()) * SLOPE * n_docs >= 1 << 62:  # beyond 64 bits: whole numbers of any size
        return np.array([100 - FLAT + SLOPE * int(x) * n_docs // n_terms for x in lengths], np.int64)
    return 100 - FLAT + (SLOPE * lengths * n_docs) // n_terms


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the ``k`` best, all ties included, with
    their final scores above 0.  ``lists``: (documents, worth) of a term each,
    worth falling.  Scores below ``least`` are of no use to the caller."""
    lists = [x for x in lists if len(x[0]) and x[1][0] > 0]
    low = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    begin, end = 0, first_read
    while True:
        for i, (docs, worth) in enumerate(lists):
            part = docs[begin:end]
            low[part] += worth[begin:end]
            seen[i, part] = True
        # what an unseen posting of each list is worth at most
        ahead = np.array([worth[end] if end < len(worth) else 0 for _, worth in lists], np.int64)
        rest = int(ahead.sum())
        bar = max(least, 1, int(np.partition(low, n_docs - k)[n_docs - k]) if n_docs > k else 0)
        open_lists = np.flatnonzero(ahead)
        high = low + rest
        for i in open_lists:
            high[seen[i]] -= ahead[i]
        able = high >= bar
        if not (high[able] > low[able]).any():
            found = np.flatnonzero(able)
            return found, low[found]
        if rest < bar:  # an unseen document cannot get there: only those still able are read on
            kept = []
            for i, (docs, worth) in enumerate(lists):
                if not ahead[i]:
                    kept.append((docs[:0], worth[:0]))
                    continue
                docs, worth = docs[end:], worth[end:]
                use = able[docs]
                kept.append((docs[use], worth[use]))
            lists, begin, end = kept, 0, (end - begin) * 2
        else:
            begin, end = end, end * 2


def _search(queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, ids: pa.DataType, k: int):
    """Segments to each query's ``k`` best of the task: (query, id, score)."""

    def best(doc_ids: pa.Array, scores: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        by_id = pc.sort_indices(doc_ids, null_placement="at_start").to_numpy()
        order = by_id[np.argsort(-scores[by_id], kind="stable")][:k]
        return doc_ids.take(pa.array(order)), scores[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids = batch.column("ids")[i].values
                term, doc, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("term", "doc", "tf"))
                m = length_norm(np.frombuffer(batch.column("lengths")[i].as_buffer(), np.int64), n_docs, n_terms)
                occurs = tf.astype(np.int64)
                worth = weights[term] * (SCALE * occurs // (TF * occurs + NORM * m[doc]))
                order = np.lexsort((doc, -worth, term))
                term, doc, worth = term[order], doc[order], worth[order]
                at = np.searchsorted(term, np.arange(len(weights) + 1))
                for q, wanted in enumerate(queries):
                    least = int(top[q][1][-1]) if q in top and len(top[q][1]) == k else 0
                    found, scores = nra([(doc[at[t] : at[t + 1]], worth[at[t] : at[t + 1]]) for t in wanted], len(doc_ids), k, least)
                    if not len(found):
                        continue
                    got = doc_ids.take(pa.array(found))
                    if q in top:
                        got, scores = pa.concat_arrays([top[q][0], got]), np.concatenate([top[q][1], scores])
                    top[q] = best(got, scores)
        for q, (doc_ids, scores) in top.items():
            yield pa.record_batch([pa.array(np.full(len(scores), q, np.int32)), doc_ids.cast(ids), pa.array(scores)], names=["query", "id", "score"])

    return run


def _ranked(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, k: int, segment: int) -> DataFrame:
    """(query, id, score, rank) of one block of queries; query: its place in
    ``items``."""
    kind = docs.schema[id_col].dataType
    arrow_ids, sql_ids = to_arrow_type(kind), kind.simpleString()
    vocabulary: dict[bytes, int] = {}
    queries = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms((text or "").encode())}) for _, text in items]
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    index = cut_lineage(
        texts.mapInArrow(_index(vocabulary, arrow_ids, segment), f"ids array<{sql_ids}>, lengths binary, term binary, doc binary, tf binary, n_docs long, n_terms long"),
        "lexical-index",
    )
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in index.select("term").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # the block's terms
        df[term] = n
    weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
    found = index.mapInArrow(_search(queries, weights, n_docs, n_terms, arrow_ids, k), f"query int, id {sql_ids}, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``k`` best documents."""
    spark = docs.sparkSession
    item_kind = items.schema[item_col].dataType
    out = None
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).toLocalIterator()
    while held := [tuple(r) for _, r in zip(range(block), asked)]:
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(held)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", item_kind)]))
        part = _ranked(docs, held, id_col, text_col, k, segment).join(F.broadcast(names), "query")
        part = part.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
        if len(held) < block:
            break
    if out is None:
        schema = T.StructType([T.StructField(item_col, item_kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return out
