"""Table-changing operators as pure functions ``(target, batch) -> target'``
(SURVEY §2.8).  Parquet has no MERGE, so each is one declarative plan.

Skew: the dedupe key ``'n/a @ n/a'`` and the empty ``job_url`` are hot groups.
Every per-key step is either a hash/sort aggregate with a map-side partial
stage or a ``row_number() = 1`` filter that Spark plans with a partial
``WindowGroupLimit`` before the exchange, so a hot key is cut to one row per
map task before it is shuffled.  Joins back to the rows are on the unique
``job_id``, never on the hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrid.functions.text import strip_lower
from jobgrid.operators.paging import LISTING_ORDER

# Fixed value: separator of the dedupe key (D12 keeps the collision).
DEDUPE_SEP = " @ "


def dedupe_key(title="title", company="company") -> Column:
    """``(title or '').strip().lower() + ' @ ' + (company or '').strip().lower()``."""
    return F.concat(strip_lower(title), F.lit(DEDUPE_SEP), strip_lower(company))


def dedupe_keys(df: DataFrame, order=LISTING_ORDER, id_col: str = "job_id") -> DataFrame:
    """One row per dedupe key: how many rows share it and which one is first."""
    first = F.min(F.struct(*order, F.col(id_col).alias("_id")))
    return (
        df.select(dedupe_key().alias("dedupe_key"), *order, id_col)
        .groupBy("dedupe_key")
        .agg(F.count(F.lit(1)).alias("n_rows"), first.alias("_first"))
        .select("dedupe_key", "n_rows", F.col("_first._id").alias("first_job_id"))
    )


def dedupe(df: DataFrame, order=LISTING_ORDER, id_col: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Keep the first row per dedupe key in insertion order; return
    ``(kept, removed)``.  Never ``dropDuplicates`` (it keeps an arbitrary row)."""
    w = Window.partitionBy("_dk").orderBy(*order, *([id_col] if id_col not in order else []))
    ranked = df.withColumn("_dk", dedupe_key()).withColumn("_rn", F.row_number().over(w))
    kept = ranked.filter(F.col("_rn") == 1).drop("_dk", "_rn")
    removed = ranked.filter(F.col("_rn") > 1).drop("_dk", "_rn")
    return kept, removed


def dedupe_keep_first(df: DataFrame, order=LISTING_ORDER, id_col: str = "job_id") -> DataFrame:
    return dedupe(df, order, id_col)[0]


def _with_key(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """The key columns once more as text that is never null (a null differs
    from every value), so that equal keys meet in plain equi-joins and a window
    and the join after it share one exchange."""
    names = [f"_k{i}" for i in range(len(keys))]
    marked = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]
    return df.withColumns(dict(zip(names, marked))), names


def _nth(df: DataFrame, names: list[str], order: list) -> DataFrame:
    """The first row per key in ``order``; cut to one a key and map task before
    the shuffle (``WindowGroupLimit``), so a hot key does not travel."""
    rn = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")


def collapse_batch(batch: DataFrame, keys: list[str], order=LISTING_ORDER, id_col: str = "job_id",
                   written: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The batch as one row per key (and ``by``): the written columns of its
    last row as ``_v_<column>``, identity and order columns of its first."""
    okey = list(order) + ([id_col] if id_col not in order else [])
    written = [c for c in batch.columns if c not in (id_col, *order)] if written is None else written
    b, names = _with_key(batch, [*by, *keys])
    last = _nth(b, names, [F.col(c).desc() for c in okey]).select(*names, *(F.col(c).alias(f"_v_{c}") for c in written))
    return _nth(b, names, okey).select(*names, *okey).join(last, names)


def upsert_matches(target: DataFrame, batch: DataFrame, keys: list[str], order=LISTING_ORDER, id_col: str = "job_id",
                   written: list[str] | None = None) -> DataFrame:
    """The batch as one row per key with ``_uid``, the id of the target row that
    it updates (null: it is new); see ``upsert_split``."""
    okey = list(order) + ([id_col] if id_col not in order else [])
    written = [c for c in batch.columns if c not in (id_col, *order)] if written is None else written
    bk = collapse_batch(batch, keys, order, id_col, written)
    # Only target rows whose key occurs in the batch can match: a semi-join
    # (broadcast by AQE when the batch's key set is small) cuts the target to
    # those rows, so the whole target is scanned for a few columns but never
    # shuffled for the match.
    t, names = _with_key(target.select(*dict.fromkeys([*keys, *okey])), keys)
    cand = t.select(*names, *okey).join(bk.select(*names), names, "left_semi")
    first = _nth(cand, names, okey).select(*names, F.col(id_col).alias("_uid"))
    return bk.join(first, names, "left").drop(*names)


def upsert_split(m: DataFrame, order=LISTING_ORDER, id_col: str = "job_id", written: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What an upsert does to its target: ``updates`` (the id of the row that a
    key updates, and its new values ``_v_<column>``) and ``inserts`` (new rows)."""
    okey = list(order) + ([id_col] if id_col not in order else [])
    values = [F.col(f"_v_{c}") for c in written]
    inserts = m.filter(F.col("_uid").isNull()).select(*okey, *(v.alias(c) for v, c in zip(values, written)))
    return m.filter(F.col("_uid").isNotNull()).select("_uid", *values), inserts


def overlay(rows: DataFrame, updates: DataFrame, written: list[str], id_col: str = "job_id", how: str = "left") -> DataFrame:
    """``rows`` with the written columns of those that ``updates`` names; with
    ``how='inner'`` those rows only.  The ids are unique, and the update set is
    broadcast by AQE when small, so the rows are not shuffled for a hot key."""
    hit = F.col("_uid").isNotNull()
    cols = [F.when(hit, F.col(f"_v_{c}")).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in rows.columns]
    return rows.join(updates, rows[id_col] == updates["_uid"], how).select(*cols)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    order=LISTING_ORDER,
    id_col: str = "job_id",
    written: list[str] | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Set form of a sequence of ``update_one(key, {$set: row}, upsert=True)``.

    * the batch collapses to one row per key: values of its last row, identity
      and insertion order of its first row (an insert followed by updates);
    * a key present in the target updates only the *first* target row with
      that key (insertion order), overlaying the written columns and keeping
      the rest; other target rows with the key are untouched;
    * keys match null-safely (a null matches null or a missing field);
    * ``scope='source'`` adds ``source`` to the key (D5 option).
    """
    keys = list(keys) + (["source"] if scope == "source" and "source" not in keys else [])
    if written is None:
        written = [c for c in batch.columns if c not in (id_col, *order)]
    for c in written:
        if c not in target.columns:
            target = target.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
    updates, inserts = upsert_split(upsert_matches(target, batch, keys, order, id_col, written), order, id_col, written)
    return overlay(target, updates, written, id_col).unionByName(inserts, allowMissingColumns=True)


def upsert_match(target: DataFrame, batch: DataFrame, keys: list[str], order=LISTING_ORDER, id_col="job_id") -> DataFrame:
    """For each batch row, the target row its upsert would update (or null).
    The target is cut to one row a key before it is shuffled; a hot key of the
    batch meets that one row in a join that AQE splits."""
    okey = list(dict.fromkeys([*order, id_col]))
    b, names = _with_key(batch.select(id_col, *keys), keys)
    t, _ = _with_key(target.select(*dict.fromkeys([*keys, *okey])), keys)
    cand = t.select(*names, *okey).join(b.select(*names).distinct(), names, "left_semi")
    first = _nth(cand, names, okey).select(*names, F.col(id_col).alias("target_job_id"))
    return b.join(first, names, "left").select(F.col(id_col).alias("batch_job_id"), "target_job_id")


def replace_source(target: DataFrame, batch: DataFrame, source: str, on_empty: str = "keep") -> DataFrame:
    """Delete every row of ``source``, insert the batch (no dedupe).

    ``on_empty='keep'`` keeps the old rows when the batch is empty (D4: an
    atomic swap); ``'clear'`` reproduces delete-before-fetch.  The emptiness
    test is a scalar subquery, evaluated once, not a join."""
    return drop_replaced(target, batch, source, on_empty).unionByName(batch, allowMissingColumns=True)


def drop_replaced(target: DataFrame, batch: DataFrame, source: str, on_empty: str = "keep") -> DataFrame:
    """``target`` without the rows of ``source`` that ``batch`` replaces."""
    if on_empty not in ("keep", "clear"):
        raise ValueError("on_empty must be 'keep' or 'clear'")
    others = F.col("source") != F.lit(source)
    if on_empty == "keep":
        empty = batch.limit(1).select((F.count(F.lit(1)) == 0).alias("e")).scalar()
        keep_old = others | empty
    else:
        keep_old = others
    return target.filter(F.coalesce(keep_old, F.lit(True)))


def delete_source(target: DataFrame, *sources: str) -> DataFrame:
    return target.filter(~F.coalesce(F.col("source").isin(*sources), F.lit(False)))


def delete_report(target: DataFrame, *sources: str) -> DataFrame:
    """How many rows each named source loses."""
    return target.filter(F.col("source").isin(*sources)).groupBy("source").agg(F.count(F.lit(1)).alias("deleted"))
