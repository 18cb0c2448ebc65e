"""Streams whose state is a table in key buckets: a micro-batch
reads the buckets of its keys and writes the rows that it changes.

* ``start_keep_first``: exact keep-first deduplication.  The state is the
  earliest row of each dedupe key in insertion order; a row that comes late but
  stands earlier takes its place, and the change log says so.
* ``start_saved_log``: save and unsave requests → the saved pairs.

Both append what they changed to ``<root>/_changes`` by writer and batch: ``-``
rows that no longer hold and ``+`` rows that now do.  A repeated batch writes
its folder again from the version before its own commit, so a batch that failed
half-way leaves the same rows as one that did not.  Buckets whose deltas have
grown are compacted after the commit.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobgrid.functions.text import valid_object_id
from jobgrid.operators import merge, saved
from jobgrid.operators.paging import LISTING_ORDER
from jobgrid.session import remove_path, write_cut
from jobgrid.sources.keyed import KeyedTable
from jobgrid.streaming.streams import SAVED_SCHEMA, _trigger

KEY = "dedupe_key"
PAIR_KEY = "pair"


def _changes_path(root: str, writer: str, batch: int) -> str:
    who = hashlib.sha256(writer.encode()).hexdigest()[:16]
    return f"{root}/_changes/writer={who}/batch={batch}"


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """All changes, with ``op`` (``-`` or ``+``), writer and batch."""
    return spark.read.parquet(f"{root}/_changes")


def _settle(table: KeyedTable, writer: str, batch: int, old: DataFrame, new: DataFrame, key: str,
            forgotten: DataFrame | None = None) -> None:
    """Log and commit the keys whose row differs between ``old`` (what stands)
    and ``new`` (what is to stand); a key that is missing in ``new`` goes.  Rows
    of the table that are ``forgotten`` go from it, but not into the log."""
    cols = table.schema.fieldNames()
    row = F.struct(*cols)
    was = old.select(F.col(key).alias("_k"), row.alias("_was"))
    will = new.select(F.col(key).alias("_k"), row.alias("_will"))
    # one row a key on either side: never a hot key
    diff, path = write_cut(was.join(will, "_k", "full_outer").filter(~F.col("_was").eqNullSafe(F.col("_will"))), "state-diff")
    gone = diff.filter("_was IS NOT NULL").select(F.lit("-").alias("op"), "_was.*")
    come = diff.filter("_will IS NOT NULL").select(F.lit("+").alias("op"), "_will.*")
    gone.unionByName(come).write.mode("overwrite").parquet(_changes_path(table.root, writer, batch))
    changes = diff.select(F.coalesce("_will", "_was").alias("r"), F.col("_will").isNull().alias("_gone")).select("r.*", "_gone")
    if forgotten is not None:
        left = forgotten.join(diff.select(F.col("_k").alias(key)), key, "left_anti")
        changes = changes.unionByName(left.withColumn("_gone", F.lit(True)))
    table.commit(changes, old, writer, batch)
    remove_path(table.spark, path)
    table.compact()


# ---- exact keep-first ----------------------------------------------------------------


def first_table(spark: SparkSession, root: str, schema: T.StructType, buckets: int = 64) -> KeyedTable:
    """The table of first rows under ``root``; made if there is none."""
    full = T.StructType([T.StructField(KEY, T.StringType()), *schema.fields])
    table = KeyedTable(spark, root, full, order=(), id_col=KEY, indexes={})
    if table.version() is None:
        table.create(spark.createDataFrame([], full), buckets=buckets)
    return table


def _first_of(rows: DataFrame, order: tuple[str, ...], id_col: str) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(*order, *([id_col] if id_col not in order else []))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_first_batch(table: KeyedTable, batch: DataFrame, writer: str, at: int, order=LISTING_ORDER,
                     id_col: str = "job_id", keep_from: tuple[str, object] | None = None) -> None:
    """One micro-batch.  ``row_number() = 1`` has a partial form before the
    exchange, so a hot key sends a row a task.  ``keep_from`` (a column and a
    value) bounds the state: rows before it are not taken in, and keys whose
    first row lies before it are forgotten, which reads the whole table."""
    if table.committed(writer, at) is not None:
        return
    rows = batch.withColumn(KEY, merge.dedupe_key()).select(*table.schema.fieldNames())
    forgotten = None
    if keep_from is not None:
        late = F.coalesce(F.col(keep_from[0]) < F.lit(keep_from[1]), F.lit(False))
        rows, forgotten = rows.filter(~late), table.read().filter(late)
    fresh, path = write_cut(_first_of(rows, order, id_col), "state-first")
    old = table.rows_of(fresh.select(KEY))
    new = _first_of(old.unionByName(fresh), order, id_col)
    _settle(table, writer, at, old, new, KEY, forgotten)
    remove_path(table.spark, path)


def start_keep_first(spark: SparkSession, src_dir: str, schema: T.StructType, root: str, checkpoint: str,
                     trigger: str | None = "available_now", files_per_batch: int | None = None,
                     span: str | None = None, event_time: str = "scraped_at", buckets: int = 64) -> StreamingQuery:
    """Stream of listings → their first rows by dedupe key.  Without ``span``
    the table equals the batch dedupe of all rows seen, whatever the order of
    the files.  With it (an interval, as ``'90 days'``) a key is forgotten once
    its first row lies further than that before the latest ``event_time`` seen."""
    writer = f"keep-first:{checkpoint}"

    def run(batch: DataFrame, batch_id: int) -> None:
        table = first_table(spark, root, schema, buckets)
        keep_from = None
        if span is not None:
            seen = batch.select(event_time).union(table.read().select(event_time))
            last = seen.agg((F.max(event_time) - F.expr(f"INTERVAL {span}")).alias("t")).first()["t"]
            keep_from = None if last is None else (event_time, last)
        keep_first_batch(table, batch, writer, batch_id, keep_from=keep_from)

    src = spark.readStream.schema(schema)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    w = src.parquet(src_dir).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


# ---- saved pairs ---------------------------------------------------------------------


def saved_table(spark: SparkSession, root: str, start: DataFrame | None = None, buckets: int | None = None) -> KeyedTable:
    """The table of saved pairs under ``root``; made, from ``start``, if there
    is none."""
    schema = T.StructType([T.StructField(PAIR_KEY, T.StringType()), *SAVED_SCHEMA.fields])
    table = KeyedTable(spark, root, schema, order=(), id_col=PAIR_KEY, indexes={})
    if table.version() is None:
        start = spark.createDataFrame([], SAVED_SCHEMA) if start is None else start
        table.create(start.select(_pair().alias(PAIR_KEY), *saved.PAIR, "saved_at"), buckets=buckets)
    return table


def _pair():
    return F.concat_ws(":", F.coalesce(F.col("user_id").cast("string"), F.lit("-")), F.coalesce("job_id", F.lit("")))


def saved_batch(table: KeyedTable, requests: DataFrame, listings: DataFrame, writer: str, at: int) -> None:
    """One micro-batch of requests, in (ts, request_id) order: only the pairs
    that it names are read and written.  Requests without a user do nothing."""
    if table.committed(writer, at) is not None:
        return
    valid = requests.filter(F.col("action").isin("save", "unsave") & F.col("user_id").isNotNull() & valid_object_id("job_id"))
    asked, path = write_cut(valid.select("request_id", *saved.PAIR, "ts", "action", _pair().alias(PAIR_KEY)), "state-requests")
    old = table.rows_of(asked.select(PAIR_KEY))
    known = listings.join(asked.select("job_id").distinct(), "job_id", "left_semi")
    new = saved.apply_requests(old.select(*saved.PAIR, "saved_at"), asked, known)
    _settle(table, writer, at, old, new.select(_pair().alias(PAIR_KEY), *saved.PAIR, "saved_at"), PAIR_KEY)
    remove_path(table.spark, path)


def start_saved_log(spark: SparkSession, requests_dir: str, request_schema: T.StructType, listings: DataFrame, root: str,
                    checkpoint: str, trigger: str | None = "available_now", files_per_batch: int | None = None) -> StreamingQuery:
    """Stream of requests → the saved pairs under ``root``."""
    writer = f"saved:{checkpoint}"

    def run(batch: DataFrame, batch_id: int) -> None:
        saved_batch(saved_table(spark, root), batch, listings, writer, batch_id)

    src = spark.readStream.schema(request_schema)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    w = src.parquet(requests_dir).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def read_saved(spark: SparkSession, root: str) -> DataFrame:
    return saved_table(spark, root).read().select(*saved.PAIR, "saved_at")
