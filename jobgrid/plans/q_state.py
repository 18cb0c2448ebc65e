"""Streams whose state is a table in key buckets, several micro-batches each."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.plans.catalog import LISTING_COLS, register, sql_dedupe_key
from jobgrid.plans.q_saved import apply_sql
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx
from jobgrid.streaming import keyed_state

_FIRST = f"""SELECT {{cols}} FROM (SELECT *, row_number() OVER (PARTITION BY {sql_dedupe_key()}
    ORDER BY scraped_date, page, job_id) AS rn FROM listings) x WHERE rn = 1"""


def _streamed_first(spark, d):
    """The listings in twelve files without order, four a micro-batch."""
    src, root = scratch_path(spark, "listings-src"), scratch_path(spark, "first")
    lst = fx.listings(spark, d)
    lst.repartition(12, "job_id").write.parquet(src)
    ckpt = scratch_path(spark, "ckpt-first")
    keyed_state.start_keep_first(spark, src, lst.schema, root, ckpt, files_per_batch=4, buckets=16).awaitTermination()
    return root, lst.schema


@register("stream_keep_first", _FIRST.format(cols=LISTING_COLS), ("listings",))
def stream_keep_first(spark, d):
    """The first row of each dedupe key, whatever file it came in."""
    root, schema = _streamed_first(spark, d)
    return keyed_state.first_table(spark, root, schema).read().select(*LISTING_COLS.split(", "))


@register("stream_keep_first_changes", _FIRST.format(cols="job_id"), ("listings",))
def stream_keep_first_changes(spark, d):
    """The listings that the change log leaves: added more often than taken back."""
    root, _ = _streamed_first(spark, d)
    n = F.sum(F.when(F.col("op") == "+", 1).otherwise(-1))
    return keyed_state.read_changes(spark, root).groupBy("job_id").agg(n.alias("n")).filter("n > 0").select("job_id")


_SQL, _CTES = apply_sql(("save", "unsave"))


@register("stream_saved_log", _SQL, ("listings", "saved_jobs", "requests"), _CTES)
def stream_saved_log(spark, d):
    """Requests in three micro-batches, in time order, on the saved pairs."""
    reqs = fx.requests(spark, d).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = reqs.agg(F.percentile_approx("_t", [0.4, 0.8])).first()[0] or [0, 0]
    req_dir, root, ckpt = (scratch_path(spark, x) for x in ("requests", "saved-log", "ckpt-saved-log"))
    keyed_state.saved_table(spark, root, fx.saved_jobs(spark, d), buckets=16)
    t = F.col("_t")
    for part in (t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), t >= cuts[1]):
        reqs.filter(part).drop("_t").write.mode("append").parquet(req_dir)
        schema = reqs.drop("_t").schema
        keyed_state.start_saved_log(spark, req_dir, schema, fx.listings(spark, d), root, ckpt).awaitTermination()
    return keyed_state.read_saved(spark, root)
