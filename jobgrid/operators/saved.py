"""Bookmarks: saved list, request classification and application (SURVEY
§2.4, §2.8).

Applying a batch is an aggregate per pair with a map-side partial stage (a
user hammering one job collapses before the shuffle); classifying it needs every
request, in order, and is one window per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrid.functions.text import valid_object_id

PAIR = ["user_id", "job_id"]


def saved_list(listings: DataFrame, saved: DataFrame, user_id=None) -> DataFrame:
    """Saved listings; a mapping whose listing is gone vanishes silently.
    One user: semi-join; all users: inner equi-join on ``job_id``."""
    if user_id is not None:
        ids = saved.filter(F.col("user_id") == F.lit(user_id)).select("job_id")
        return listings.join(ids, "job_id", "left_semi")
    return saved.select(*PAIR).join(listings, "job_id", "inner")


def saved_count(listings: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved jobs per user, counting only mappings whose listing exists."""
    live = saved.join(listings.select("job_id"), "job_id", "left_semi")
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_saved"))


def classify_requests(requests: DataFrame, listings: DataFrame, saved: DataFrame) -> DataFrame:
    """Save and unsave requests → status, equal to serving them one by one in
    ``(ts, request_id)`` order.  Save: ``invalid_id`` / ``not_found`` /
    ``already_saved`` / ``created``; unsave: ``invalid_id`` / ``not_found`` /
    ``removed``, checked in that order.

    A pair is saved before a request if the last effective request for it was
    a save, or, with none, if the saved table has it: one ``lag`` over the
    pair.  Only valid rows are joined, so malformed ids never meet in a task."""
    r = requests.filter(F.col("action").isin("save", "unsave"))
    is_save = F.col("action") == "save"
    valid = valid_object_id("job_id")
    found = listings.select("job_id").withColumn("_found", F.lit(True))
    pre = saved.select(*PAIR).withColumn("_pre", F.lit(True))
    ok = r.filter(valid).join(found, "job_id", "left").join(pre, PAIR, "left")
    effective = ok.filter(~is_save | F.col("_found").isNotNull())
    order = Window.partitionBy(*PAIR).orderBy("ts", "request_id")
    held = F.coalesce(F.lag("action").over(order) == "save", F.col("_pre"), F.lit(False))
    out = ("request_id", "user_id", "job_id", "action")
    served = effective.withColumn("_held", held).select(
        *out,
        F.when(is_save & F.col("_held"), "already_saved").when(is_save, "created")
        .when(F.col("_held"), "removed").otherwise("not_found").alias("status"),
    )
    missing = ok.filter(is_save & F.col("_found").isNull()).select(*out, F.lit("not_found").alias("status"))
    invalid = r.filter(~valid).select(*out, F.lit("invalid_id").alias("status"))
    return served.unionByName(missing).unionByName(invalid)


def classify_saves(requests: DataFrame, listings: DataFrame, saved: DataFrame) -> DataFrame:
    """The save requests' statuses, the unsaves between them applied."""
    return classify_requests(requests, listings, saved).filter(F.col("action") == "save").drop("action")


def classify_unsaves(requests: DataFrame, listings: DataFrame, saved: DataFrame) -> DataFrame:
    """The unsave requests' statuses, the saves between them applied."""
    return classify_requests(requests, listings, saved).filter(F.col("action") == "unsave").drop("action")


def apply_requests(saved: DataFrame, requests: DataFrame, listings: DataFrame, actions=("save", "unsave")) -> DataFrame:
    """New saved table after a batch of save / unsave requests, equal to
    applying them one by one in ``(ts, request_id)`` order.

    Per pair the last action decides presence.  A present pair keeps its old
    ``saved_at`` when the batch has no unsave for it, else takes the first save
    after the last unsave.  Unique per (user, job) by construction."""
    r = requests.filter(F.col("action").isin(*actions) & valid_object_id("job_id"))
    saves = r.filter(F.col("action") == "save").join(listings.select("job_id"), "job_id", "left_semi")
    r = saves.unionByName(r.filter(F.col("action") == "unsave")).select(*PAIR, "ts", "request_id", "action")
    is_save = F.col("action") == "save"
    a = r.groupBy(*PAIR).agg(
        F.max(F.struct("ts", "request_id", "action")).alias("_last"),
        F.max(F.when(~is_save, F.struct("ts", "request_id"))).alias("_lu"),
        F.min(F.when(is_save, F.col("ts"))).alias("_first_save"),
    )
    # first save after the last unsave, for the pairs that have an unsave
    relapsed = a.filter(F.col("_lu").isNotNull()).select(*PAIR, "_lu")
    after = (
        r.filter(is_save)
        .join(relapsed, PAIR)
        .filter(F.struct("ts", "request_id") > F.col("_lu"))
        .groupBy(*PAIR)
        .agg(F.min("ts").alias("_fsa"))
    )
    # One full outer join with the saved table decides every pair: untouched
    # (no request), present (last action save) or removed (last action unsave).
    summary = a.join(after, PAIR, "left")
    j = saved.select(*PAIR, F.col("saved_at").alias("_old")).join(summary, PAIR, "full_outer")
    touched = F.col("_last").isNotNull()
    saved_at = (
        F.when(~touched, F.col("_old"))
        .when(F.col("_lu").isNull(), F.coalesce("_old", "_first_save"))
        .otherwise(F.col("_fsa"))
    )
    keep = ~touched | (F.col("_last.action") == "save")
    return j.filter(keep).select(*PAIR, saved_at.alias("saved_at"))


def apply_saves(saved: DataFrame, requests: DataFrame, listings: DataFrame) -> DataFrame:
    return apply_requests(saved, requests, listings, ("save",))


def apply_unsaves(saved: DataFrame, requests: DataFrame, listings: DataFrame) -> DataFrame:
    return apply_requests(saved, requests, listings, ("unsave",))
