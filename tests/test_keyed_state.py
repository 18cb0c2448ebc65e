"""Streams over key buckets: late earlier rows, bounded state, repeated batches,
what a batch writes; email changes against serving them one by one."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from jobgrid.operators import saved
from jobgrid.operators.email_changes import email_changes
from jobgrid.session import scratch_path
from jobgrid.streaming import keyed_state

LISTING = "job_id string, title string, company string, scraped_date date, page int"


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def listing(spark, *rows):
    return spark.createDataFrame([(i, t, "c", day(n), 1) for i, t, n in rows], LISTING)


def test_a_late_earlier_row_takes_the_place(spark):
    first = listing(spark, ("b", "T ", 5), ("x", None, 1))
    table = keyed_state.first_table(spark, scratch_path(spark, "first"), first.schema, 4)
    keyed_state.keep_first_batch(table, first, "w", 0)
    late = listing(spark, ("a", "t", 3), ("c", "t", 9), ("y", "", 2))
    for _ in range(2):  # a repeated batch changes nothing
        keyed_state.keep_first_batch(table, late, "w", 1)
    assert sorted(r.job_id for r in table.read().collect()) == ["a", "x"]
    log = sorted((r.batch, r.op, r.job_id) for r in keyed_state.read_changes(spark, table.root).collect())
    assert log == [(0, "+", "b"), (0, "+", "x"), (1, "+", "a"), (1, "-", "b")]
    keyed_state.keep_first_batch(table, listing(spark), "w", 2)  # an empty batch
    assert table.read().count() == 2


def test_state_is_bounded_by_the_span(spark):
    src, root, ckpt = (scratch_path(spark, x) for x in ("src", "first", "ckpt"))
    schema = listing(spark).schema
    for rows in ([("a", "t", 0), ("b", "u", 9)], [("c", "v", 20), ("d", "t", 1)], [("e", "t", 21)]):
        listing(spark, *rows).write.mode("append").parquet(src)
        options = dict(span="10 days", event_time="scraped_date", buckets=4)
        keyed_state.start_keep_first(spark, src, schema, root, ckpt, **options).awaitTermination()
    # a and b are forgotten once c is seen, d comes too late, e is new again
    assert sorted(r.job_id for r in keyed_state.first_table(spark, root, schema).read().collect()) == ["c", "e"]
    assert sorted((r.op, r.job_id) for r in keyed_state.read_changes(spark, root).collect()) == [("+", x) for x in "abce"]


def files(root: str, version: int) -> int:
    return sum(f.endswith(".parquet") for d, _, names in os.walk(f"{root}/rows/v={version}") for f in names)


def test_saved_batches_write_what_they_change(spark):
    jobs = [f"{i:024x}" for i in range(300)]
    listings = spark.createDataFrame([(j,) for j in jobs], "job_id string")
    t0 = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([(u, j, t0) for u in range(20) for j in jobs[:100]], keyed_state.SAVED_SCHEMA)
    table = keyed_state.saved_table(spark, scratch_path(spark, "saved"), cur, 32)
    r, schema = random.Random(2), "request_id long, user_id long, job_id string, ts timestamp_ntz, action string"
    whole = cur
    for batch in range(4):
        n = (3, 60, 0, 200)[batch]
        rows = [(batch * 1000 + i, r.randrange(22), r.choice([*jobs, "bad", "f" * 24]), t0 + dt.timedelta(days=batch, seconds=r.randrange(50)),
                 r.choice(["save", "unsave", "search"])) for i in range(n)] + [(batch * 1000 + 999, None, jobs[0], t0, "save")]
        reqs = spark.createDataFrame(rows, schema)
        before = table.version()
        keyed_state.saved_batch(table, reqs, listings, "w", batch)
        assert files(table.root, before + 1) <= min(n, 32)
        whole = saved.apply_requests(whole, reqs.filter("user_id IS NOT NULL"), listings)
        whole = spark.createDataFrame(whole.collect(), keyed_state.SAVED_SCHEMA)
        got = sorted(map(tuple, keyed_state.read_saved(spark, table.root).collect()))
        assert got == sorted(map(tuple, whole.collect()))
    live = table.live()["rows"]
    assert any(len(x) > 1 for x in live.values())
    table.compact(share=0.0, deltas=0)
    assert all(len(x) == 1 for x in table.live()["rows"].values())
    assert sorted(map(tuple, keyed_state.read_saved(spark, table.root).collect())) == got


def served(users, reqs):
    held, out = dict(users), {}
    norm = lambda e: None if e is None else e.strip().lower()
    held = {u: norm(e) for u, e in held.items()}
    for rid, u, e, *_ in sorted(reqs, key=lambda x: (x[3], x[0])):
        e = norm(e)
        if u not in held:
            out[rid] = "no_user"
        elif not e or e == held[u]:
            out[rid] = "unchanged"
        elif e in held.values():
            out[rid] = "in_use"
        else:
            out[rid], held[u] = "changed", e
    return out, held


def test_email_changes_equal_serving_one_by_one(spark):
    t0 = dt.datetime(2024, 1, 1)
    for seed in range(3):
        r = random.Random(seed)
        emails = [f"e{i}@x.y" for i in range(9)]
        users = [(u, r.choice([*emails[:6], None, f" E{u}@X.y"])) for u in range(8)]  # some share one from the start
        reqs = [(i, r.randrange(9), r.choice([*emails, "", None, " E3@x.Y "]), t0 + dt.timedelta(seconds=r.randrange(12))) for i in range(30)]
        got, done = email_changes(spark.createDataFrame(users, "user_id long, email string"),
                                  spark.createDataFrame(reqs, "request_id long, user_id long, email string, ts timestamp_ntz").repartition(3))
        want, held = served(users, reqs)
        assert {x.request_id: x.status for x in got.collect()} == want
        assert {x.user_id: x.email and x.email.strip().lower() for x in done.collect()} == held


def test_a_hot_email_that_is_kept_takes_one_round(spark, monkeypatch):
    from jobgrid.operators import email_changes as m

    rounds, real = [], m._round
    monkeypatch.setattr(m, "_round", lambda *a: (rounds.append(1), real(*a))[1])
    users = spark.range(2000).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), "id").alias("email"))
    reqs = spark.range(1, 2000).select(F.col("id").alias("request_id"), F.col("id").alias("user_id"), F.lit("u0").alias("email"))
    got, _ = email_changes(users, reqs, order=F.col("request_id"))
    assert got.groupBy("status").count().collect()[0].asDict() == {"status": "in_use", "count": 1999} and len(rounds) == 1
    empty = email_changes(users, reqs.limit(0), order=F.col("request_id"))
    assert empty[0].count() == 0 and empty[1].count() == 2000
