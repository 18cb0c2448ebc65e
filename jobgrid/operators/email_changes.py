"""Email changes in time order (SURVEY §2.4 ``email_conflicts``, §2.8
``profile_patch``): a change is refused while another user holds the email, so
whether one passes depends on those before it.

The result equals serving the requests one by one.  It is found in rounds over
a timeline of who holds an email from when to when.  In a round

* every request for an email whose holder has no open request left is settled
  at once, by a minimum an email with a map-side partial and an equi-join that
  AQE splits: a hot email that someone keeps costs one round;
* the first open request of a user, if it is the first open one for its email
  too, is settled unless a holder of that email has an earlier open request.

The earliest open request of all is always settled, so the rounds end; there
are as many as the longest chain of requests that wait for each other.  Each
round's requests are a written table that replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrid.operators.users import email_norm
from jobgrid.session import cut_lineage, remove_path, write_cut

#: order of a request: time, then id; both in one number
ORDER = "decimal(38,0)"


def request_order(ts: str = "ts", request_id: str = "request_id") -> Column:
    at = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)") * F.expr(f"CAST('{10**19}' AS decimal(20,0))")
    return (at + F.col(request_id).cast("decimal(19,0)")).cast(ORDER)


def _holdings(users: DataFrame, reqs: DataFrame) -> DataFrame:
    """(user_id, e, s, c_end, p_end): who surely holds an email from ``s`` on
    (null: from the start) until ``c_end`` (null: the last known one), and the
    earliest order at which they may leave it (null: never)."""
    opened = reqs.filter("state = 'open'").groupBy("user_id").agg(F.min("o").alias("u_open"))
    taken = reqs.filter("state = 'changed'").select("user_id", "e", F.col("o").alias("s"))
    every = users.select("user_id", "e", F.lit(None).cast(ORDER).alias("s")).unionByName(taken)
    after = Window.partitionBy("user_id").orderBy(F.col("s").asc_nulls_first())
    held = every.withColumn("c_end", F.lead("s").over(after)).join(opened, "user_id", "left")
    return held.filter("e IS NOT NULL").select("user_id", "e", "s", "c_end", F.coalesce("c_end", "u_open").alias("p_end"))


def _round(users: DataFrame, reqs: DataFrame) -> DataFrame:
    held = _holdings(users, reqs)
    opened = reqs.filter("state = 'open'")
    # emails that someone keeps for good, from the first such order on
    kept = held.filter("p_end IS NULL").groupBy("e").agg(F.min(F.coalesce("s", F.lit(-1).cast(ORDER))).alias("from_o"))
    marked = opened.join(kept, "e", "left").withColumn("kept", F.coalesce(F.col("o") > F.col("from_o"), F.lit(False)))
    rest = marked.filter("NOT kept")
    first_e = opened.groupBy("e").agg(F.min("o").alias("o"))
    first_u = opened.groupBy("user_id").agg(F.min("o").alias("o"))
    heads = rest.select("user_id", "e", "o").join(first_e, ["e", "o"], "left_semi").join(first_u, ["user_id", "o"], "left_semi")
    # at most one head an email: the join grows with the holdings of these emails
    met = heads.join(held.select("e", "s", "c_end", "p_end", F.col("user_id").alias("holder")), "e", "left")
    before = F.col("holder").isNotNull() & (F.col("s").isNull() | (F.col("s") < F.col("o")))
    stands = before & (F.col("c_end").isNull() | (F.col("c_end") > F.col("o")))
    sure = before & (F.col("holder") != F.col("user_id")) & (F.col("p_end").isNull() | (F.col("p_end") > F.col("o")))
    met = met.groupBy("user_id", "e", "o").agg(
        F.max(F.coalesce(stands & (F.col("holder") == F.col("user_id")), F.lit(False))).alias("own"),
        F.max(F.coalesce(sure, F.lit(False))).alias("sure"),
        F.max(F.coalesce(stands, F.lit(False))).alias("maybe"),
    )
    state = F.when(F.col("own") | F.col("sure"), "kept").when(~F.col("maybe"), "changed").otherwise("open")
    settled = met.select("o", state.alias("new"))
    key = [c for c in reqs.columns if c != "state"]
    out = marked.join(settled, "o", "left").select(
        *key, F.when(F.col("kept"), "kept").otherwise(F.coalesce("new", "state")).alias("state")
    )
    return reqs.filter("state <> 'open'").unionByName(out)


def email_changes(users: DataFrame, requests: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``requests`` (request_id, user_id, email, and what ``order`` needs) →
    (statuses, users').

    Status: ``no_user``; ``unchanged`` (a blank email, or the one the user
    has); ``in_use`` (another user has it then); ``changed``.  ``order`` is a
    unique number that grows with time, by default of (ts, request_id).  Emails
    are compared trimmed and in lower case.  Users who share an email from the
    start all hold it.  ``users'`` has the emails after the batch, normalised
    where they changed; all other columns stay."""
    order = request_order() if order is None else order
    spark = users.sparkSession
    asked = requests.select("request_id", "user_id", email_norm().alias("e"), order.cast(ORDER).alias("o"))
    blank = F.coalesce(F.col("e") == "", F.lit(True))
    asked = asked.join(users.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    state = F.when(F.col("known").isNull(), "no_user").when(blank, "unchanged").otherwise("open")
    reqs, path = write_cut(asked.select("request_id", "user_id", "e", "o", state.alias("state")), "email-round")
    # users who ask, and those who hold an email that is asked for
    mine = users.select("user_id", email_norm().alias("e"))
    opened = reqs.filter("state = 'open'")
    near = mine.join(opened.select("user_id").distinct(), "user_id", "left_semi").unionByName(
        mine.join(opened.select("user_id").distinct(), "user_id", "left_anti").join(opened.select("e").distinct(), "e", "left_semi")
    )
    near = cut_lineage(near, "email-holders")
    while not reqs.filter("state = 'open'").isEmpty():
        reqs, new_path = write_cut(_round(near, reqs), "email-round")
        remove_path(spark, path)
        path = new_path
    # a request that changed nothing asked for the user's own email or for another's
    by_user = Window.partitionBy("user_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("state") == "changed", F.col("e")), ignorenulls=True).over(by_user)
    served = reqs.join(near.withColumnRenamed("e", "e0"), "user_id", "left").withColumn("own", F.coalesce(own, "e0"))
    status = F.when(F.col("state") != "kept", F.col("state")).when(F.col("own") == F.col("e"), "unchanged").otherwise("in_use")
    statuses = served.select("request_id", "user_id", F.col("e").alias("email_norm"), status.alias("status"))
    last = reqs.filter("state = 'changed'").groupBy("user_id").agg(F.max_by("e", "o").alias("_e"))
    done = users.join(last, "user_id", "left").select(*(F.coalesce("_e", "email").alias(c) if c == "email" else F.col(c) for c in users.columns))
    return statuses, done
