"""Steps whose cost must follow their rows: no table is dealt out round robin
(which sorts and spills it), none is shuffled more often than the job needs."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from jobgrid.operators import rank_index, search_index
from jobgrid.session import scratch_path, spread
from jobgrid.sources import fixtures as fx
from jobgrid.sources import keyed
from jobgrid.sources.landing import build_landing


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def one_file(spark, n=1000):
    path = scratch_path(spark, "one-file")
    spark.range(0, n, 1, 1).selectExpr("id", "id % 3 AS k").write.parquet(path)
    return spark.read.parquet(path)


def test_spread_deals_rows_without_a_sort(spark):
    scan = one_file(spark)
    dealt = spread(scan)
    assert "RoundRobin" not in plan_of(dealt) and dealt.columns == ["id", "k"]
    assert sorted(x.id for x in dealt.collect()) == list(range(1000))


def test_a_large_row_group_is_spread(spark, tmp_path):
    pq.write_table(pa.table({"id": range(20000)}), tmp_path / "one.parquet", compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        scan = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # all but one are empty
        dealt = spread(scan)
        held = dealt.select(F.spark_partition_id().alias("p"), "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(x.id for x in held) == list(range(20000)) and "Exchange" in plan_of(dealt)


def test_stored_table_is_written_by_the_tasks_that_made_it(spark):
    rows = spark.range(0, 300, 1, 3)
    got = fx.stored(spark, ("scale-test",), lambda: rows)
    assert len(got.inputFiles()) == 3 and got.count() == 300


def test_landing_shuffles_the_listings_once(spark, small_dir):
    pages = build_landing(fx.listings(spark, small_dir), 1)
    plan = plan_of(pages)
    assert plan.count("Exchange") == 1
    assert plan.index("partial_collect_list") < plan.index("Exchange")  # above it: no partial lists travel


def test_search_counts_texts_without_listing_pairs(spark):
    texts = spark.createDataFrame([("red gear", "x", "Pune", 5), ("ring", "gear", None, 2), (None, None, "Pune", 1)], "title string, company string, location string, n long")
    matches = spark.createDataFrame([(n, v) for n in range(40) for v in ("red gear", "gear")] + [(99, "Pune"), (99, "red gear")], "no long, value string")
    for block in (7, 10_000):
        hits = search_index.text_hits(texts, matches, block)
        assert {r.no: r.results for r in hits.collect()} == {**{n: 7 for n in range(40)}, 99: 6}
    values = search_index.field_values(texts)
    assert sorted(r.value for r in values.collect()) == ["Pune", "gear", "red gear", "ring", "x"]


def test_a_large_table_has_a_bounded_number_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(rank_index, "MOST_RANGES", 4)
    index = rank_index.RankIndex.build(spark.range(1000).selectExpr("id"), scratch_path(spark, "many"), ("id",), 10)
    assert index.ranges().count() <= 4
    assert [x.id for x in rank_index.page(index, 31, 10).collect()] == list(range(300, 310))


def test_a_bucket_is_written_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("cast(id as string) AS job_id", "'x' AS title")
        table = keyed.KeyedTable(spark, scratch_path(spark, "keyed"), rows.schema, order=(), indexes={})
        table.create(rows, buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = table.root.removeprefix("file:") + "/rows/v=0"
    files = [f for b in ("b=0", "b=1") for f in os.listdir(f"{at}/{b}") if f.endswith(".parquet")]
    assert len(files) > 2 and table.read().count() == 5000
