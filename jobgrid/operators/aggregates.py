"""Counts and reports.  All are hash aggregates with a map-side
partial stage; only small results (one row, one row per source or per page)
leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrid.operators import merge


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def distinct_sources(df: DataFrame) -> DataFrame:
    """Distinct source values (sorted, joined) and how many."""
    per = df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("source").isNotNull())
    return per.agg(
        F.count(F.lit(1)).alias("sources_count"),
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"),
    )


def counts(df: DataFrame) -> DataFrame:
    """``GET /count``: total, number of sources and their names in one row."""
    per = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").cast("bigint").alias("total"),
        F.count("source").alias("sources_count"),
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"),
    )


def count_filtered(df: DataFrame, limit: int = 250, **filters) -> DataFrame:
    """Total under a filter (``filters`` as for ``list_filtered``, or an
    already filtered frame) and ``ceil(total/limit)`` pages."""
    if int(limit) < 1:
        raise ValueError("limit must be >= 1")
    if filters:
        from jobgrid.operators.filters import list_filtered

        df = list_filtered(df, **filters)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(int(limit))).cast("bigint").alias("total_pages")
    )


def page_stats(records: DataFrame) -> DataFrame:
    """Records kept per (source, page)."""
    return records.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n_records"))


def run_report(batch: DataFrame, final: DataFrame, removed: DataFrame) -> DataFrame:
    """Run summary as (label, n) rows: saved per source, ``Total Scraped``,
    ``Duplicates Removed``, ``Total Unique`` (= scraped − removed, the figure
    the run prints) and ``Actual Rows`` (the true row count, D3)."""
    rolled = batch.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("g"))
    per = rolled.filter(F.col("g") == 0)
    total = rolled.filter(F.col("g") == 1).select(F.lit("Total Scraped").alias("label"), "n")
    rem = removed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("Duplicates Removed").alias("label"), "n")
    # One aggregate over both inputs, no join: scraped − removed.
    unique = (
        batch.select(F.lit(1).alias("s"), F.lit(0).alias("r"))
        .unionByName(removed.select(F.lit(0).alias("s"), F.lit(1).alias("r")))
        .agg((F.sum("s") - F.sum("r")).cast("bigint").alias("n"))
        .select(F.lit("Total Unique").alias("label"), "n")
    )
    actual = final.agg(F.count(F.lit(1)).alias("n")).select(F.lit("Actual Rows").alias("label"), "n")
    return (
        per.select(F.col("source").alias("label"), "n")
        .unionByName(total)
        .unionByName(rem)
        .unionByName(unique)
        .unionByName(actual)
    )


def dedupe_report(df: DataFrame) -> DataFrame:
    kept, removed = merge.dedupe(df)
    return run_report(df, kept, removed)
