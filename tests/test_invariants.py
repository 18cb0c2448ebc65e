"""Invariants over the fixture tables and plan assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators import filters, merge, search
from jobgrid.operators import normalize as N
from jobgrid.plans import q_landing
from jobgrid.plans.ingest import empty_listings, ingest_run
from jobgrid.sources import fixtures as fx
from jobgrid.sources.landing import source_config


def test_dedupe_idempotent_and_partitions_rows(spark, small_dir):
    df = fx.listings(spark, small_dir)
    kept, removed = merge.dedupe(df)
    assert kept.count() + removed.count() == df.count()
    again, none = merge.dedupe(kept)
    assert again.count() == kept.count() and none.count() == 0


def test_upsert_idempotent(spark, small_dir):
    df = fx.listings(spark, small_dir)
    t, b = df.filter(F.substring("job_id", 1, 1) < "8"), df.filter(F.substring("job_id", 1, 1) >= "8")
    once = merge.upsert(t, b, ["job_url"])
    twice = merge.upsert(once, b, ["job_url"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_replace_source_keeps_old_rows_on_empty_batch(spark, small_dir):
    df = fx.listings(spark, small_dir)
    empty = df.limit(0)
    assert merge.replace_source(df, empty, "Indeed").count() == df.count()
    assert merge.replace_source(df, empty, "Indeed", on_empty="clear").filter("source = 'Indeed'").count() == 0


def test_saved_unique_after_apply(spark, small_dir):
    from jobgrid.operators import saved

    out = saved.apply_requests(fx.saved_jobs(spark, small_dir), fx.requests(spark, small_dir), fx.listings(spark, small_dir))
    assert out.count() == out.select("user_id", "job_id").distinct().count()


def test_stream_ingest_equals_batch(spark, small_dir):
    from __spark_entry__ import queries

    q = queries()
    a = q["ingest_run"](spark, small_dir)
    b = q["stream_ingest"](spark, small_dir)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_ingest_isolates_a_failing_source(spark, small_dir):
    res = ingest_run(empty_listings(spark), q_landing.landing(spark, small_dir), source_config(spark),
                     sources=("Internshala", "Nowhere", "Naukri"))
    assert "Nowhere" in res.errors
    assert {r.source for r in res.listings.select("source").distinct().collect()} == {"Internshala", "Naukri"}


def test_invalid_regex_rejected_up_front(spark, small_dir):
    import pytest

    with pytest.raises(ValueError):
        filters.search(fx.listings(spark, small_dir), "(unclosed")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_dedupe_has_partial_window_group_limit(spark, small_dir):
    plan = _plan(merge.dedupe_keep_first(fx.listings(spark, small_dir)))
    assert "WindowGroupLimit" in plan


def test_plan_source_filter_prunes_partitions(spark, small_dir):
    df = filters.list_filtered(fx.listings(spark, small_dir), source="Naukri")
    s = df._jdf.queryExecution().executedPlan().toString()
    part = s.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "source" in part and "Naukri" in part


def test_plan_no_python_outside_card_extractor(spark, small_dir):
    lst = fx.listings(spark, small_dir)
    for df in (filters.search(lst, "red"), merge.dedupe_keep_first(lst),
               N.normalize(q_landing.landing(spark, small_dir), "Naukri", source_config(spark))[0]):
        p = _plan(df)
        assert "PythonUDF" not in p and "MapInPandas" not in p and "ArrowEvalPython" not in p


def test_batch_search_never_broadcasts_listings(spark, small_dir):
    lst = fx.listings(spark, small_dir)
    log = fx.requests(spark, small_dir).filter("action = 'search'")
    hits = search._theta(lst, log.select("q").distinct(), 8, 4)  # the large-query-set path
    p = _plan(hits)
    assert "BroadcastNestedLoopJoin" in p and "BuildRight" in p


def test_ingest_reports_collapsed_keys(spark, small_dir):
    res = ingest_run(empty_listings(spark), q_landing.landing(spark, small_dir), source_config(spark))
    rows = {r.source: r for r in res.collapsed.collect()}
    assert set(rows) == {"Internshala", "Unstop", "Naukri", "Indeed"}
    for r in rows.values():
        assert r.rows - r.keys == r.collapsed >= 0
    assert rows["Indeed"].collapsed == 0
    assert rows["Internshala"].collapsed > 0  # link-less cards share the key ''
