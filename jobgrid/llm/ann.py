"""Approximate nearest neighbours in robust-pruned directed graphs, by shard.

Method.  Distinct vectors are dealt to shards of bounded size by a hash.  In
each, nodes are taken in random order, many at a time: a greedy beam search
from the medoid proposes neighbours, and pruning by relaxed distances keeps a
diverse few (a candidate goes if ``alpha`` times its distance from a kept one is
no more than its distance from the node); edges are also laid back and pruned
alike.  Two rounds give the graph.  A query is searched by beam in every shard;
the nearest found are scored on the original vectors in double precision and
merged.

Scale.  Each shard is built on its own.  Queries go to the shards in blocks of
bounded size.  Of equal vectors, one node keeps the smallest ids, as many as an
answer can name (exact, since equal vectors tie and ties go to smaller ids), so
a vector that a third of all rows have is one node.

Defined cases.  Vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids.  Only vectors of a query's dimension
are its candidates.  Rows that repeat an id and a vector count once.  Of the
input only the id and vector columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrid.llm.frames import store


SHARD, BLOCK = 2048, 4096
DEGREE, BEAM, ALPHA, BATCH = 32, 64, 1.2, 256
#: nodes that a beam search expands in one step
AT_ONCE = 4


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in the beam, nodes expanded) of each query, nearest first, -1
    where there are fewer.  ``vectors`` and ``queries`` have length one."""
    n, degree = edges.shape
    m = len(queries)
    seen = np.zeros((m, n + 1), bool)  # column n: no node
    seen[:, [start, n]] = True
    nodes = np.full((m, beam), n)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    nodes[:, 0], far[:, 0], done[:, 0] = start, 1 - queries @ vectors[start], False
    expanded = []
    rows = np.arange(m)
    while len(rows):
        first = np.argsort(done[rows], axis=1, kind="stable")[:, :AT_ONCE]  # the nearest not expanded
        here = np.where(np.take_along_axis(done[rows], first, 1), n, np.take_along_axis(nodes[rows], first, 1))
        done[rows[:, None], first] = True
        step = np.full((m, AT_ONCE), n)
        step[rows] = here
        expanded.append(step)
        nexts = np.where(here[:, :, None] < n, edges[np.minimum(here, n - 1)], n).reshape(len(rows), -1)
        nexts = np.sort(nexts, axis=1)
        nexts[:, 1:][nexts[:, 1:] == nexts[:, :-1]] = n
        nexts[seen[rows[:, None], nexts]] = n
        seen[rows[:, None], nexts] = True
        d = 1 - np.matmul(vectors[np.minimum(nexts, n - 1)], queries[rows][:, :, None])[:, :, 0]
        d[nexts == n] = np.inf
        all_d = np.concatenate([far[rows], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_d, best, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], nexts], axis=1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], nexts == n], axis=1), best, 1)
        rows = rows[~done[rows].all(axis=1)]
    return np.where(nodes == n, -1, nodes), np.concatenate(expanded, axis=1)


def robust_prune(vectors: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept neighbours of each node, -1 where there are fewer; candidates
    may hold -1, the node itself and repeats."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == node[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    there = vectors[np.maximum(candidates, 0)]
    # distances between unit vectors, squared: so is the relaxation
    own = 2 - 2 * np.matmul(there, vectors[node][:, :, None])[:, :, 0]
    own[bad] = np.inf
    out = np.full((len(node), degree), -1, np.int32)
    rows = np.arange(len(node))
    for r in range(degree):
        pick = np.argmin(own, axis=1)
        alive = np.isfinite(own[rows, pick])
        if not alive.any():
            break
        out[alive, r] = candidates[rows, pick][alive]
        between = 2 - 2 * np.matmul(there, there[rows, pick][:, :, None])[:, :, 0]
        own[(alpha * alpha * between <= own) & alive[:, None]] = np.inf
        own[rows, pick] = np.inf
    return out


def build_graph(vectors: np.ndarray, seed: int, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, medoid) of unit vectors; every row of ``edges`` has ``degree``
    node numbers, len(vectors) where there are fewer."""
    n = len(vectors)
    random = np.random.default_rng(seed)
    edges = np.full((n, degree), n, np.int32)
    if n > 1:
        some = random.integers(0, n - 1, (n, min(degree // 2, n - 1)), np.int32)
        edges[:, : some.shape[1]] = some + (some >= np.arange(n)[:, None])
    medoid = int(np.argmax(vectors @ vectors.mean(axis=0)))
    for _ in range(2):
        order = random.permutation(n)
        for begin in range(0, n, BATCH):
            node = order[begin : begin + BATCH]
            _, expanded = beam_search(vectors, edges, medoid, vectors[node])
            candidates = np.concatenate([expanded, edges[node]], axis=1)
            kept = robust_prune(vectors, node, np.where(candidates == n, -1, candidates), degree, alpha)
            edges[node] = np.where(kept < 0, n, kept)
            # edges back
            to, frm = kept.ravel(), np.repeat(node, degree)
            to, frm = to[to >= 0], frm[to >= 0]
            by = np.argsort(to, kind="stable")
            to, frm = to[by], frm[by]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            new = np.full((len(target), int(count.max(initial=0))), -1)
            new[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
            old = edges[target]
            pool = np.concatenate([np.where(old == n, -1, old), new], axis=1)
            for part in np.array_split(np.arange(len(target)), 1 + pool.size // 40_000):
                if len(part):
                    again = robust_prune(vectors, target[part], pool[part], degree, alpha)
                    edges[target[part]] = np.where(again < 0, n, again)
    return edges, medoid


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def _build(keep: int):
    def run(shard: pa.Table) -> pa.Table:
        vectors = _matrix(shard.column("vector"))
        edges, medoid = build_graph(_unit(vectors), seed=shard.column("shard")[0].as_py())
        ids = np.full((len(vectors), keep), -1, np.int64)
        for i, x in enumerate(shard.column("ids").to_pylist()):
            ids[i, : len(x)] = x
        one = {"shard": shard.column("shard")[0].as_py(), "dim": vectors.shape[1], "medoid": medoid}
        one |= {"vectors": vectors.tobytes(), "edges": edges.tobytes(), "ids": ids.tobytes()}
        return pa.Table.from_pylist([one], pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("medoid", pa.int32())] + [(x, pa.binary()) for x in ("vectors", "edges", "ids")]))

    return run, "shard int, dim int, medoid int, vectors binary, edges binary, ids binary"


def _block(rows: pa.Table) -> pa.Table:
    """One row of a block of queries."""
    one = {"block": rows.column("block")[0].as_py(), "dim": rows.column("dim")[0].as_py()}
    one |= {"queries": _matrix(rows.column("vector")).tobytes(), "query_ids": rows.column("id").to_numpy().tobytes()}
    return pa.Table.from_pylist([one], pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("queries", pa.binary()), ("query_ids", pa.binary())]))


def _search(k: int, keep: int):
    """The k nearest of each query in one shard."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda name, kind: np.frombuffer(row[name], kind)
                vectors = get("vectors", np.float32).reshape(-1, row["dim"])
                ids, edges = get("ids", np.int64).reshape(-1, keep), get("edges", np.int32).reshape(-1, DEGREE)
                queries, query_ids = get("queries", np.float32).reshape(-1, row["dim"]), get("query_ids", np.int64)
                unit, wide = _unit(vectors), vectors.astype(np.float64)
                length = np.sqrt((wide * wide).sum(axis=1))
                for begin in range(0, len(queries), BATCH):
                    q, mine = queries[begin : begin + BATCH].astype(np.float64), query_ids[begin : begin + BATCH]
                    found, _ = beam_search(unit, edges, row["medoid"], _unit(q))
                    node = np.maximum(found, 0)
                    score = np.matmul(wide[node], q[:, :, None])[:, :, 0] / (length[node] * np.sqrt((q * q).sum(axis=1))[:, None])
                    named = np.where((found >= 0)[:, :, None], ids[node], -1).reshape(len(q), -1)
                    score = np.repeat(score, keep, axis=1)
                    score[(named < 0) | (named == mine[:, None])] = -np.inf
                    best = np.lexsort((named, -score), axis=1)[:, :k]
                    score, named = np.take_along_axis(score, best, 1), np.take_along_axis(named, best, 1)
                    good = np.isfinite(score)
                    owner = np.broadcast_to(mine[:, None], named.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (owner, named, score)], names=["query_id", "vec_id", "score"])

    return run, "query_id long, vec_id long, score double"


def nearest(
    rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``queries`` the ``k``
    nearest rows of ``rows`` found, by cosine, its own id left out."""
    spark = rows.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    keep = k + 1  # the query's own id may be among them
    same = W.partitionBy("vector").orderBy("id")
    first = clean(rows).dropDuplicates(["vector", "id"]).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= keep)
    nodes = store(first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-nodes")
    shards = nodes.count() // SHARD + 1
    dim = F.size("vector")
    shard = F.pmod(F.xxhash64("vector"), F.lit(shards)) + shards * dim  # dimensions never mix
    build, schema = _build(keep)
    graphs = nodes.select(shard.cast("int").alias("shard"), "vector", "ids").groupBy("shard").applyInArrow(build, schema)
    graphs = store(graphs, "ann-graphs")
    asked = clean(queries).dropDuplicates(["id", "vector"])
    blocks = asked.count() // BLOCK + 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)) + blocks * dim
    asked = asked.select(block.cast("int").alias("block"), dim.alias("dim"), "vector", "id").groupBy("block").applyInArrow(_block, "block int, dim int, queries binary, query_ids binary")
    to_do = graphs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    to_do = to_do.withColumn("block", (F.col("b") + blocks * F.col("dim")).cast("int")).drop("b").join(asked.drop("dim"), "block")
    search, schema = _search(k, keep)
    parts = max(graphs.count() * blocks, 1)
    found = to_do.repartition(parts, "shard", "block").mapInArrow(search, schema)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
