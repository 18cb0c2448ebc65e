"""Batch search: each logged query → its number of hits.

The cost is queries × listings.  The distinct query set is measured first
(one number reaches the driver):

* up to ``literal_max`` distinct queries: their text is fetched (bounded by
  that check) and becomes literal ``rlike`` columns of ONE aggregate over the
  listings, so each pattern compiles once and the scan runs in whole-stage
  codegen;
* beyond it: theta joins against broadcast chunks of at most ``literal_max``
  queries each, never broadcasting the listing side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrid.operators.filters import java_pattern

FIELDS = ("title", "company", "location")


def _hit(java: str):
    pat = "(?iu)" + java
    return F.coalesce(
        F.col("title").rlike(pat) | F.col("company").rlike(pat) | F.col("location").rlike(pat), F.lit(False)
    )


def query_hits(listings: DataFrame, qs: DataFrame, literal_max: int = 512) -> DataFrame:
    """(q, results) for each distinct ``q``; empty q counts all rows; an
    invalid pattern gives a null count (the endpoint's error)."""
    distinct = qs.select("q").distinct()
    n = distinct.count()
    if n <= literal_max:
        texts = [r["q"] for r in distinct.collect() if r["q"] is not None]
        if not texts:
            return distinct.select("q", F.lit(None).cast("bigint").alias("results")).limit(0)
        cols = []
        for i, q in enumerate(texts):
            if q == "":
                e = F.count(F.lit(1))
            elif (java := java_pattern(q)) is not None:
                e = F.count_if(_hit(java))
            else:
                e = F.lit(None).cast("bigint")
            cols.append(e.alias(f"c{i}"))
        wide = listings.select(*FIELDS).agg(*cols)
        pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"c{i}").cast("bigint").alias("results"))
                          for i, q in enumerate(texts)])
        return wide.select(F.inline(pairs))
    return _theta(listings, distinct, n, literal_max)


def _patterns(qs: pd.Series) -> pd.Series:
    """Each distinct query (never per listing) for the engine that runs it,
    null for a malformed one."""
    return qs.map(java_pattern, na_action="ignore")


def _theta(listings: DataFrame, distinct: DataFrame, n: int, chunk: int) -> DataFrame:
    """Theta join against broadcast chunks of at most ``chunk`` queries."""
    n_chunks = -(-n // chunk)
    qd = (
        distinct.filter(F.col("q").isNotNull())
        .withColumn("_java", F.pandas_udf(_patterns, T.StringType())("q"))
        .withColumn("_ok", F.col("_java").isNotNull())
        .withColumn("_chunk", F.pmod(F.xxhash64("q"), F.lit(n_chunks)))
    )
    lst = listings.select(*FIELDS)
    total = lst.agg(F.count(F.lit(1)).alias("n")).scalar()
    pat = F.concat(F.lit("(?iu)"), F.col("_java"))
    cond = F.rlike("title", pat) | F.rlike("company", pat) | F.rlike("location", pat)
    out = None
    for c in range(n_chunks):
        part = qd.filter(F.col("_chunk") == c)
        probe = F.broadcast(part.filter((F.col("q") != "") & F.col("_ok")).select("q", "_java"))
        hits = lst.join(probe, cond, "inner").groupBy("q").agg(F.count(F.lit(1)).alias("results"))
        res = part.join(hits, "q", "left").select(
            "q",
            F.when(~F.col("_ok"), F.lit(None))
            .when(F.col("q") == "", total)
            .otherwise(F.coalesce("results", F.lit(0)))
            .cast("bigint")
            .alias("results"),
        )
        out = res if out is None else out.unionByName(res)
    return out


def search_batch(listings: DataFrame, log: DataFrame, literal_max: int = 512) -> DataFrame:
    """(request_id, q, results) for every logged search."""
    hits = query_hits(listings, log, literal_max)
    return log.select("request_id", "q").join(hits, "q", "left").select("request_id", "q", "results")
