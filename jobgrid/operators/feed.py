"""Per-user feed by preferred job type.

A user's preference filters listings by ``type = p OR duration = p``; a blank
preference means no filter.  Instead of joining users × listings, listings
are ranked once per candidate key (each of its non-empty ``type`` /
``duration`` values, plus one shared "everything" key) and cut to
``per_user`` rows per key with ``row_number`` (partial ``WindowGroupLimit``
before the exchange).  Users then equi-join on the key, so the output is at
most ``users × per_user`` rows and no pair set is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrid.operators.filters import with_type
from jobgrid.operators.paging import LISTING_ORDER

FEED_ALL = "\u0000all"


def user_feed(users: DataFrame, listings: DataFrame, per_user: int = 250, order=LISTING_ORDER) -> DataFrame:
    if int(per_user) < 1:
        raise ValueError("per_user must be >= 1")
    lst = with_type(listings).select("job_id", *[c for c in order if c != "job_id"], "type", "duration")
    vals = F.array_distinct(F.filter(F.array("type", "duration"), lambda v: v.isNotNull() & (v != "")))
    by_value = lst.select(*order, F.explode(vals).alias("feed_key"))
    everything = lst.select(*order, F.lit(FEED_ALL).alias("feed_key"))
    w = Window.partitionBy("feed_key").orderBy(*order)
    ranked = (
        by_value.unionByName(everything)
        .withColumn("feed_rank", F.row_number().over(w))
        .filter(F.col("feed_rank") <= int(per_user))
        .select("feed_key", "job_id", "feed_rank")
    )
    pref = F.col("preferred_job_type")
    u = users.select(
        "user_id", F.when(pref.isNull() | (pref == ""), F.lit(FEED_ALL)).otherwise(pref).alias("feed_key")
    )
    return u.join(ranked, "feed_key").select("user_id", "job_id", "feed_rank")
