"""Deep pages and feeds with cursors from a rank index, and listing filters
over columns that the fixture leaves empty."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobgrid.operators import filters, paging, rank_index
from jobgrid.plans.catalog import LISTING_COLS, register
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx

L, U = fx.listings, fx.users
RANGE_ROWS = 1000  # so that the small tables have many ranges
DEEP_PAGE, LIMIT, MORE_PAGES, FEED_LIMIT = 14, 250, 7, 60
_ORDER = "scraped_date, page, job_id"


@register("page_ranked", f"SELECT {LISTING_COLS} FROM listings ORDER BY {_ORDER} LIMIT {LIMIT} OFFSET {(DEEP_PAGE - 1) * LIMIT}", ("listings",))
def page_ranked(spark, d):
    """A deep page, read from the ranges that hold it."""
    index = rank_index.RankIndex.build(L(spark, d), scratch_path(spark, "ranks"), range_rows=RANGE_ROWS)
    return rank_index.page(index, DEEP_PAGE, LIMIT)


@register(
    "load_more_ranked",
    f"SELECT {LISTING_COLS}, row_number() OVER (ORDER BY {_ORDER}) - 1 AS rank FROM listings ORDER BY {_ORDER} LIMIT {MORE_PAGES * LIMIT}",
    ("listings",),
)
def load_more_ranked(spark, d):
    index = rank_index.RankIndex.build(L(spark, d), scratch_path(spark, "ranks"), range_rows=RANGE_ROWS)
    return rank_index.load_more(index, MORE_PAGES, LIMIT)


@register(
    "user_feed_after",
    f"""SELECT u.user_id, rk.job_id, rk.feed_rank FROM users u JOIN (
          SELECT k, job_id, row_number() OVER (PARTITION BY k ORDER BY {_ORDER}) AS feed_rank
          FROM (SELECT job_id, scraped_date, page, duration AS k FROM listings WHERE coalesce(duration, '') <> ''
                UNION ALL SELECT job_id, scraped_date, page, '*ALL*' FROM listings) c) rk
        ON rk.k = CASE WHEN coalesce(u.preferred_job_type, '') = '' THEN '*ALL*' ELSE u.preferred_job_type END
        AND rk.feed_rank > (u.user_id % 9) * 45 AND rk.feed_rank <= (u.user_id % 9) * 45 + {FEED_LIMIT}""",
    ("listings", "users"),
)
def user_feed_after(spark, d):
    """Feeds that go on after what each user has seen."""
    feeds = rank_index.build_feeds(L(spark, d), scratch_path(spark, "feeds"), range_rows=RANGE_ROWS)
    users = U(spark, d).withColumn("seen", (F.col("user_id") % 9) * 45)
    return rank_index.feed_after(users, feeds, FEED_LIMIT)


_TYPE = "CASE WHEN page % 3 = 0 THEN 'Permanent' WHEN page % 3 = 1 THEN 'permanent' WHEN page % 7 = 2 THEN '' END"


@register("filter_type_values", f"SELECT {LISTING_COLS}, type FROM (SELECT *, {_TYPE} AS type FROM listings) x WHERE type = 'Permanent'", ("listings",))
def filter_type_values(spark, d):
    """The type filter over listings that have types."""
    return filters.list_filtered(L(spark, d).withColumn("type", F.expr(_TYPE)), type="Permanent").select(*LISTING_COLS.split(", "), "type")


_LAST = ("1995-06-17", 3, "8")  # inside the order dates of every scale


@register(
    "page_after_day",
    f"SELECT {LISTING_COLS} FROM listings WHERE (scraped_date, page, job_id) > (DATE '{_LAST[0]}', {_LAST[1]}, '{_LAST[2]}') ORDER BY {_ORDER} LIMIT {LIMIT}",
    ("listings",),
)
def page_after_day(spark, d):
    day, no, job = _LAST
    return paging.after(L(spark, d), (dt.date.fromisoformat(day), no, job), LIMIT)
