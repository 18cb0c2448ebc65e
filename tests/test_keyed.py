"""The table in key buckets: what a step writes, versions, compaction."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from jobgrid.operators import merge
from jobgrid.plans.ingest import empty_listings, ingest_into, ingest_run, listing_table
from jobgrid.session import scratch_path
from jobgrid.sources import keyed
from jobgrid.sources.landing import source_config
from jobgrid.streaming import streams
from tests.test_ingest import naukri, pages
from tests.test_replay import random_pages, shown

SCHEMA = "job_id string, title string, company string, job_url string, seq int, note string"


def table_of(spark, rows, buckets=32):
    df = spark.createDataFrame(rows, SCHEMA)
    table = keyed.KeyedTable(spark, scratch_path(spark, "keyed"), df.schema, order=("seq",))
    table.create(df, buckets=buckets)
    return table


def files(root: str, version: int) -> dict[str, int]:
    """Bytes by data file of one version."""
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root.removeprefix("file:"))
            for f in names if f"/v={version}/" in d + "/" and f.endswith(".parquet")}


def test_a_step_writes_in_proportion_to_its_batch(spark):
    rows = [(f"{i:024}", f"t{i}", "c", f"u{i}", i, "x" * 50) for i in range(20_000)]
    table = table_of(spark, rows)
    whole = sum(files(table.root, 0).values())
    sizes = []
    for n in (3, 30):
        batch = [(f"{90000 + n * 100 + i:024}", f"t{i * 7}", "c", f"u{i * 7}", 90_000 + i, "new") for i in range(n - 1)]
        batch.append((f"{80000 + n:024}", f"fresh{n}", "c", f"fresh{n}", 99_000, "new"))
        v = keyed.upsert(table, spark.createDataFrame(batch, SCHEMA), ["job_url"])
        wrote = files(table.root, v)
        sizes.append(sum(wrote.values()))
        # one file a bucket and kind at most: rows, and the index entries of the fresh row only
        assert len(wrote) <= n + 2 and len([f for f in wrote if "/by_" in f]) == 2
        assert len(files(table.root, 0)) == 3 * 32  # nothing of the old version is rewritten
    assert sizes[0] < whole / 40 and sizes[1] < whole / 6
    got = {r.job_url: r for r in table.read().collect()}
    assert len(got) == 20_002 and got["u7"].note == "new" and got["u7"].job_id == f"{7:024}" and got["u203"].seq == 203


def test_upserts_equal_the_set_form(spark):
    rows = [(f"t{i}", ["a", "b", None, ""][i % 4], ["X", None, "x "][i % 3], ["u", "", None, f"v{i}"][i % 4], i, "old") for i in range(24)]
    for keys in (["job_url"], ["title", "company"]):
        table, plain = table_of(spark, rows, 4), spark.createDataFrame(rows, SCHEMA)
        for step in range(2):
            batch = [(f"b{step}.{i}", ["a", "q", None][i % 3], ["X", None][i % 2], ["u", None, f"v{i + step}"][i % 3], 100 + 50 * step + i, f"new{step}") for i in range(14)]
            b = spark.createDataFrame(batch, SCHEMA)
            plain = merge.upsert(plain, b, keys, order=("seq",))
            keyed.upsert(table, b, keys, writer="w", at=step)
            keyed.upsert(table, b, keys, writer="w", at=step)  # repeated: not written again
            if step == 0:
                table.compact(0.0)
                assert all(len(x) == 1 for kind in table.live().values() for x in kind.values())
        assert shown(table.read()) == shown(plain)
        assert table.version() == 3
        before = shown(table.read(1))
        assert before != shown(table.read()) and not any("new1" in r for r in before)
        assert table.vacuum() > 0
        assert shown(table.read()) == shown(plain)


def test_an_unlogged_write_is_not_seen(spark):
    table = table_of(spark, [("a", "t", "c", "u", 1, "old")], 2)
    left = spark.createDataFrame([("b", "t2", "c", "u2", 2, "lost")], SCHEMA).withColumn("_gone", F.lit(False))
    table._write("rows", left, "job_id", 1, False, 2)  # a writer that died before its record
    assert [r.job_id for r in table.read().collect()] == ["a"]
    keyed.upsert(table, spark.createDataFrame([("c", "t3", "c", "u3", 3, "new")], SCHEMA), ["job_url"])
    assert sorted(r.job_id for r in table.read().collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        table.create(table.read())


def test_refreshes_into_the_table_equal_the_refresh(spark):
    rows, cfg = random_pages(5, 2), source_config(spark)
    want = shown(ingest_run(empty_listings(spark), pages(spark, *rows), cfg, None).listings)
    table = listing_table(spark, scratch_path(spark, "keyed"))
    for run in sorted({x[0] for x in rows}):
        ingest_into(table, pages(spark, *(x for x in rows if x[0] == run)), cfg)
    assert shown(table.read()) == want
    table.compact(0.0)
    table.vacuum()
    assert shown(table.read()) == want


def test_marked_runs_are_never_split(spark):
    unstop = '{"data": [{"title": "n", "job_type": null}, {"title": "u", "public_url": "x"}]}'
    rows = [("r1", "Naukri", p, 200, naukri((f"t{p}", "c", f"u{p}"))) for p in range(1, 6)] + [("r1", "Unstop", 1, 200, unstop)]
    land, marks, root, ckpt = (scratch_path(spark, x) for x in ("land", "marks", "keyed", "ckpt"))
    mark = lambda *m: spark.createDataFrame(list(m), streams.MARKS_SCHEMA).write.mode("append").parquet(marks)
    run = lambda: streams.start_marked_ingest(spark, land, marks, root, ckpt).awaitTermination()
    pages(spark, *rows[:3]).write.partitionBy("source").parquet(land)
    mark(("r1", 6))
    with pytest.raises(Exception, match="have not landed"):
        run()
    pages(spark, *rows[3:], ("r2", "Naukri", 1, 200, naukri(("half", "c", "h")))).write.mode("append").partitionBy("source").parquet(land)
    run()
    table = listing_table(spark, root)
    assert sorted(r.title for r in table.read().collect()) == ["t1", "t2", "t3", "t4", "t5", "u"]  # r2 is not marked yet
    pages(spark, ("r2", "Naukri", 2, 200, naukri(("rest", "c", "r")))).write.mode("append").partitionBy("source").parquet(land)
    mark(("r2", None))
    run()
    assert sorted(r.title for r in table.read().collect()) == ["half", "rest", "t1", "t2", "t3", "t4", "t5", "u"]
    rejects = streams.read_reports(spark, root, "rejects")
    assert [(r.run_id, r.reason, r.batch) for r in rejects.collect()] == [("r1", "null job_type", 0)]
    assert {r.batch for r in streams.read_reports(spark, root, "collapsed").collect()} == {0, 1}


def test_a_step_that_adds_rows_does_not_shuffle_the_table(spark):
    rows = [(f"{i:024}", f"t{i}", "c", f"u{i}", i, "old") for i in range(3000)]
    table = table_of(spark, rows, 4)
    batch = [("n" * 24, "fresh", "c", "fresh", 9000, "new"), ("m" * 24, "t7", "c", "u7", 9001, "new")]
    keyed.upsert(table, spark.createDataFrame(batch, SCHEMA), ["job_url"])
    now = table.read()
    plan = now._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Window" not in plan and "LeftAnti" in plan
    got = {r.job_url: (r.job_id, r.note) for r in now.collect()}
    assert len(got) == now.count() == 3001 and got["u7"] == (f"{7:024}", "new") and got["fresh"] == ("n" * 24, "new")
    # ids that are null or come twice: the newest of an id stands for it, as before
    odd = [("a", "t1", "c", "u1", 1, "old"), ("a", "t2", "c", "u2", 2, "old"), (None, "t3", "c", "u3", 3, "old"), ("b", "t4", "c", "u4", 4, "old")]
    table = table_of(spark, odd, 1)
    keyed.upsert(table, spark.createDataFrame([("b", "t9", "c", "u9", 9, "new"), ("c", "t4", "c", "u4", 10, "new")], SCHEMA), ["job_url"])
    assert len(shown(table.read())) == 3 and {r.job_id for r in table.read().collect()} == {"a", "b", None}
