"""Operator options and decisions not covered by the registered queries."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobgrid.operators import filters, merge, paging, users
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx
from jobgrid.streaming import streams


def test_keyset_page_equals_offset_page(spark, small_dir):
    df = fx.listings(spark, small_dir)
    first = paging.page(df, 1, 50).collect()
    last = first[-1]
    nxt = paging.after(df, (last.scraped_date, last.page, last.job_id), 50)
    assert [r.job_id for r in nxt.collect()] == [r.job_id for r in paging.page(df, 2, 50).collect()]


@pytest.mark.parametrize("page_no,limit", [(0, 10), (1, 0), (-1, 5)])
def test_page_rejects_bad_arguments(spark, small_dir, page_no, limit):
    with pytest.raises(ValueError):
        paging.page(fx.listings(spark, small_dir), page_no, limit)


def test_has_more():
    assert paging.has_more(501, 2, 250) and not paging.has_more(500, 2, 250)


def test_upsert_scope_source_keeps_other_sources(spark):
    schema = "job_id string, seq int, job_url string, source string, title string"
    t = spark.createDataFrame([("t1", 1, "u", "A", "old")], schema)
    b = spark.createDataFrame([("b1", 9, "u", "B", "new")], schema)
    d5 = merge.upsert(t, b, ["job_url"], order=("seq",))
    assert sorted((r.job_id, r.source, r.title) for r in d5.collect()) == [("t1", "B", "new")]
    scoped = merge.upsert(t, b, ["job_url"], order=("seq",), scope="source")
    assert sorted((r.job_id, r.source, r.title) for r in scoped.collect()) == [("b1", "B", "new"), ("t1", "A", "old")]


def test_delete_users_cascade(spark, small_dir):
    u, s = fx.users(spark, small_dir), fx.saved_jobs(spark, small_dir)
    ids = u.filter(F.col("user_id") < 10).select("user_id")
    left = users.delete_users(u, ids)
    left2, saved2 = users.delete_users(u, ids, s, cascade=True)
    assert left.count() == left2.count() == u.count() - 10
    assert saved2.filter(F.col("user_id") < 10).count() == 0
    assert s.filter(F.col("user_id") < 10).count() > 0  # D10: without cascade the mappings stay


def test_signup_defaults_and_earliest_wins(spark):
    schema = ("user_id long, name string, email string, mobile string, password_length int, work_status string")
    existing = spark.createDataFrame([(1, "Ann", "a@x.io", "9000000001", 8, "fresher")], schema)
    batch = spark.createDataFrame(
        [
            (2, "Bob", " A@X.io ", "9000000002", 8, "fresher"),  # taken (stored form)
            (3, "Cy", "c@x.io", "9000000003", 8, "experienced"),
            (4, "Cyd", "C@x.io", "9000000004", 8, "fresher"),  # later duplicate in the batch
            (5, "D", "d@x.io", "123", 2, None),  # invalid
        ],
        schema,
    )
    out = {r.user_id: r for r in users.signup_batch(existing, batch).collect()}
    assert out[2].reason == "email_exists" and out[3].status == "created" and out[4].reason == "email_exists"
    assert out[5].reason == "invalid:name,password,mobile,work_status"
    assert out[3].experience_level == "Fresher" and out[3].created_at is not None


def test_literal_mode_does_not_interpret_regex(spark, small_dir):
    df = fx.listings(spark, small_dir)
    lit = filters.search(df, "C++", mode="literal").count()
    assert lit == df.filter(F.lower("title").contains("c++")).count()
    assert lit > 0


def test_stream_dedupe_with_watermark(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", "X", base), ("A ", "x", base + dt.timedelta(minutes=1)), ("b", "Y", base)]
    src = scratch_path(spark, "wm-src")
    schema = "title string, company string, scraped_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(src)
    out = scratch_path(spark, "wm-out")
    q = streams.start_dedupe(spark, src, spark.read.parquet(src).schema, out, scratch_path(spark, "wm-ck"),
                             watermark="1 hour")
    q.awaitTermination()
    assert sorted(r.dedupe_key for r in spark.read.parquet(out).collect()) == ["a @ x", "b @ y"]


def test_read_landing_one_run(spark, small_dir):
    from jobgrid.plans.q_landing import landing_pages
    from jobgrid.sources.landing import read_landing

    path = scratch_path(spark, "landing-read")
    landing_pages(spark, small_dir).write.partitionBy("source").parquet(path)
    one = landing_pages(spark, small_dir).select("run_id").first().run_id
    df = read_landing(spark, path, run_id=one)
    assert {r.run_id for r in df.select("run_id").distinct().collect()} == {one}


def test_count_filtered_with_filters(spark, small_dir):
    from jobgrid.operators import aggregates

    df = fx.listings(spark, small_dir)
    a = aggregates.count_filtered(df, 100, search="red").first()
    b = aggregates.count_filtered(filters.list_filtered(df, search="red"), 100).first()
    assert a == b and a.total_pages == -(-a.total // 100)


def test_upsert_keeps_fields_the_source_does_not_write(spark):
    from jobgrid.plans.ingest import PROVENANCE, SOURCE_WRITES

    schema = "job_id string, seq int, title string, company string, job_url string, stipend string, source string"
    t = spark.createDataFrame([("t1", 1, "Dev", "Acme", "u", "INR 5", "Internshala")], schema)
    b = spark.createDataFrame([("b1", 9, "Dev", "Acme", "u", None, "Naukri")], schema)
    written = [c for c in SOURCE_WRITES["Naukri"] if c in b.columns]
    assert "stipend" not in written and PROVENANCE
    out = merge.upsert(t, b, ["title", "company", "job_url"], order=("seq",), written=written).collect()
    assert [(r.job_id, r.stipend, r.source) for r in out] == [("t1", "INR 5", "Naukri")]


def test_python_only_regex_syntax_rejected(spark, small_dir):
    with pytest.raises(ValueError):
        filters.search(fx.listings(spark, small_dir), "(?P<x>gear)")
