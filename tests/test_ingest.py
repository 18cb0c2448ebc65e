"""The refresh over hand-made landed pages."""

from __future__ import annotations

import json

from jobgrid.plans.ingest import RUN_ORDER, empty_listings, ingest_run
from jobgrid.session import cut_lineage, scratch_path
from jobgrid.sources import snapshot as snap
from jobgrid.sources.landing import LANDING_SCHEMA, source_config
from jobgrid.streaming import streams


def naukri(*jobs) -> str:
    return json.dumps({"results": [{"title": t, "company": c, "location": "Pune", "redirect_url": u} for t, c, u in jobs]})


def linkedin(*jobs) -> str:
    card = ('<li class="result-card"><h3 class="result-card__title">{}</h3><h4 class="result-card__subtitle">{}</h4>'
            '<span class="job-result-card__location">Pune</span>'
            '<a class="result-card__full-card-link" href="{}">x</a></li>')
    return "<ul>" + "".join(card.format(*j) for j in jobs) + "</ul>"


def pages(spark, *rows):
    """Landed pages of (run_id, source, page, status, body)."""
    kinds = {"run_id": 0, "source": 1, "page": 2, "status": 3, "body": 4}
    full = [tuple(r[kinds[f]] if f in kinds else "2024-01-01T00:00:00" if f == "fetched_at" else None
                  for f in LANDING_SCHEMA.fieldNames()) for r in rows]
    return spark.createDataFrame(full, LANDING_SCHEMA)


def stored(df) -> list[tuple]:
    return sorted((r.source, r.title, r.run_id) for r in df.collect())


def test_every_landed_source_is_merged(spark):
    landing = pages(spark, ("r1", "Naukri", 1, 200, naukri(("a", "A", "u1"))),
                    ("r1", "LinkedIn", 1, 200, linkedin(("b", "B", "u2"))))
    both = [("LinkedIn", "b", "r1"), ("Naukri", "a", "r1")]
    res = ingest_run(empty_listings(spark), landing, source_config(spark), None)
    assert not res.errors and stored(res.listings) == both and res.left_out.count() == 0
    assert {r.label: r.n for r in res.report.collect()}["LinkedIn"] == 1
    four = ingest_run(empty_listings(spark), landing, source_config(spark), RUN_ORDER)
    assert stored(four.listings) == both[1:]
    assert [tuple(r) for r in four.left_out.collect()] == [("LinkedIn", 1)]

    src, root = scratch_path(spark, "landed"), scratch_path(spark, "live")
    ckpt = scratch_path(spark, "ckpt")
    landing.write.parquet(src)
    streams.start_ingest(spark, src, root, ckpt).awaitTermination()
    assert stored(snap.read_snapshot(spark, root)) == both
    # neither a batch without LinkedIn nor a blocked page takes the rows away
    for row in (("r2", "Naukri", 1, 200, naukri(("c", "C", "u3"))), ("r3", "LinkedIn", 1, 429, "")):
        pages(spark, row).write.mode("append").parquet(src)
        streams.start_ingest(spark, src, root, ckpt).awaitTermination()
    assert stored(snap.read_snapshot(spark, root)) == [both[0], both[1], ("Naukri", "c", "r2")]
    pages(spark, ("r4", "LinkedIn", 1, 200, linkedin(("d", "D", "u4")))).write.mode("append").parquet(src)
    streams.start_ingest(spark, src, root, ckpt).awaitTermination()
    assert stored(snap.read_snapshot(spark, root)) == [("LinkedIn", "d", "r4"), both[1], ("Naukri", "c", "r2")]


def indeed(*jobs) -> str:
    recs = [{"job_title": t, "employer_name": c, "job_apply_link": u} for t, c, u in jobs]
    return json.dumps({"data": {"jobs": recs}})


def test_one_call_over_n_runs_equals_n_calls(spark):
    cfg = source_config(spark)
    rows = [
        ("r1", "Naukri", 1, 200, naukri(("a", "A", "u1"), ("b", "B", "u2"))),
        ("r1", "Indeed", 1, 200, indeed(("x", "X", "i1"), ("gone", "G", "i2"))),
        ("r1", "LinkedIn", 1, 200, linkedin(("z", "Z", "u1"), ("old", "O", "l1"))),  # rewrites Naukri's first row
        ("r2", "Naukri", 1, 200, naukri(("a", "A", "u1"), ("x", "X", "n1"))),  # an x before r2's Indeed one
        ("r2", "Indeed", 1, 200, indeed(("x", "X", "i1"), ("y", "Y", "i3"))),
        ("r3", "Indeed", 1, 429, ""),  # no rows: r2's stay
        ("r3", "LinkedIn", 1, 200, linkedin(("new", "N", "l2"))),
    ]
    want = empty_listings(spark)
    collapsed, removed = 0, 0
    for run in ("r1", "r2", "r3"):
        res = ingest_run(want, pages(spark, *(r for r in rows if r[0] == run)), cfg, None)
        assert not res.errors
        collapsed += sum(r["collapsed"] or 0 for r in res.collapsed.collect())
        removed += res.removed.count()
        want = cut_lineage(res.listings)
    want = sorted(map(tuple, want.collect()), key=repr)
    one = ingest_run(empty_listings(spark), pages(spark, *reversed(rows)), cfg, None)
    assert not one.errors
    assert sorted(map(tuple, one.listings.select(*empty_listings(spark).columns).collect()), key=repr) == want
    assert sum(r["collapsed"] or 0 for r in one.collapsed.collect()) == collapsed and one.removed.count() == removed
    got = stored(one.listings)
    assert ("Indeed", "gone", "r1") not in got and ("Indeed", "y", "r2") in got and ("LinkedIn", "old", "r1") not in got

    src, root = scratch_path(spark, "landed"), scratch_path(spark, "live")
    pages(spark, *rows).repartition(4).write.parquet(src)
    streams.start_ingest(spark, src, root, scratch_path(spark, "ckpt")).awaitTermination()
    assert stored(snap.read_snapshot(spark, root)) == got


def test_a_failure_is_not_a_result(spark, small_dir, monkeypatch):
    """A source whose rows could not be written: no query, table or stream
    passes what is left for the whole."""
    import pytest
    from __spark_entry__ import queries

    from jobgrid.plans import ingest

    def full(df, name="step"):
        if "naukri" in name:
            raise OSError("no space left on device")
        return cut_lineage(df, name)

    monkeypatch.setattr(ingest, "cut_lineage", full)
    for key in ("keyed_ingest_by_run", "ingest_run_by_run", "ingest_run"):
        with pytest.raises(RuntimeError, match="no space left"):
            queries()[key](spark, small_dir)
    table = ingest.listing_table(spark, scratch_path(spark, "keyed"))
    landing = pages(spark, ("r1", "Naukri", 1, 200, naukri(("a", "A", "u1"))), ("r1", "LinkedIn", 1, 200, linkedin(("b", "B", "u2"))))
    with pytest.raises(RuntimeError, match="no space left"):
        ingest.ingest_into(table, landing, source_config(spark))
    assert table.version() == 0


def test_a_batch_reads_the_pages_of_one_source_only(spark):
    """Each source's step of a stream reads its own files, and only files of
    the batch; the folder's name holds a blank and a percent sign."""
    src = scratch_path(spark, "landed at 100%")
    rows = [(f"r{i}", s, 1, 200, "") for i in range(4) for s in ("Naukri", "LinkedIn")]
    pages(spark, *rows).write.partitionBy("source").parquet(src)
    got = []

    def run(batch, _):
        of = streams.pages_of(batch, src).filter("source = 'Naukri'")
        got.append((sorted(r.run_id for r in of.collect()), of._jdf.queryExecution().executedPlan().toString()))

    for extra in ((), (("r9", "Naukri", 1, 200, ""),)):
        if extra:
            pages(spark, *extra).write.mode("append").partitionBy("source").parquet(src)
        read = spark.readStream.schema(LANDING_SCHEMA).parquet(src).selectExpr("*", "_metadata.file_path AS _file")
        read.writeStream.foreachBatch(run).option("checkpointLocation", src + "-ckpt").trigger(availableNow=True).start().awaitTermination()
    assert [x for x, _ in got] == [["r0", "r1", "r2", "r3"], ["r9"]]
    assert all("FileScan parquet" in plan and "(source#" in plan.split("PartitionFilters")[1] for _, plan in got)
