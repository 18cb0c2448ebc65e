"""Pages and feeds from ranges against sorting the whole table."""

from __future__ import annotations

import pytest

from jobgrid.operators import paging, rank_index
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx


@pytest.fixture(scope="module")
def index(spark, small_dir):
    return rank_index.RankIndex.build(fx.listings(spark, small_dir), scratch_path(spark, "ranks"), range_rows=500)


def test_pages_equal_offset_pages(spark, small_dir, index):
    df = fx.listings(spark, small_dir)
    total = df.count()
    for no, limit in [(1, 40), (7, 250), (total // 100, 100), (total // 100 + 1, 100), (10_000, 250)]:
        assert [x.job_id for x in rank_index.page(index, no, limit).collect()] == [x.job_id for x in paging.page(df, no, limit).collect()]
    more = rank_index.load_more(index, 9, 100).orderBy("rank").collect()
    assert [x.rank for x in more] == list(range(900))
    assert [x.job_id for x in more] == [x.job_id for x in paging.load_more(df, 9, 100).collect()]


def test_deep_page_reads_few_ranges(spark, small_dir, index):
    ranges = index.ranges().count()
    assert ranges >= 8
    deep = rank_index.page(index, fx.listings(spark, small_dir).count() // 100 - 1, 100)
    read = {f.split("/r=")[1].split("/")[0] for f in deep.inputFiles() if "/r=" in f}
    assert 1 <= len(read) < 3


def test_hot_leading_value_lies_in_several_ranges(spark):
    rows = spark.range(4000).selectExpr("'same' AS day", "id AS job_id")
    index = rank_index.RankIndex.build(rows, scratch_path(spark, "hot"), ("day", "job_id"), 500)
    assert index.ranges().count() >= 8
    assert [x.job_id for x in rank_index.page(index, 30, 100).collect()] == list(range(2900, 3000))


def test_empty_table(spark):
    index = rank_index.RankIndex.build(spark.range(0).selectExpr("id"), scratch_path(spark, "none"), ("id",))
    assert rank_index.page(index, 1, 10).count() == 0


@pytest.mark.parametrize("no,limit", [(0, 10), (1, 0)])
def test_bad_arguments(index, no, limit):
    with pytest.raises(ValueError):
        rank_index.page(index, no, limit)


def test_cursor_reaches_every_listing_of_a_feed(spark, small_dir):
    listings = fx.listings(spark, small_dir)
    feeds = rank_index.build_feeds(listings, scratch_path(spark, "feeds"), range_rows=700)
    want = [x.job_id for x in listings.orderBy(*paging.LISTING_ORDER).select("job_id").collect()]
    limit = len(want) // 7
    users = spark.range(9).selectExpr("id AS user_id", "CASE WHEN id % 2 = 0 THEN '' END AS preferred_job_type", f"id * {limit} AS seen")
    got = rank_index.feed_after(users, feeds, limit).orderBy("user_id", "feed_rank").collect()
    assert [x.job_id for x in got] == want
    assert [x.feed_rank for x in got] == list(range(1, len(want) + 1))
