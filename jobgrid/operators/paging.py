"""Offset paging, load-more and keyset paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Total insertion order of the listing fixture (D1).  A production snapshot
# orders by its ``insert_seq`` columns instead.
LISTING_ORDER = ("scraped_date", "page", "job_id")


def _check(page: int, limit: int) -> None:
    if int(page) < 1 or int(limit) < 1:
        raise ValueError("page and limit must be >= 1")  # D15


def page(df: DataFrame, page: int = 1, limit: int = 250, order=LISTING_ORDER) -> DataFrame:
    """Page ``page`` of size ``limit``: skip ``(page-1)*limit`` rows in a total
    order.  Plans as ``TakeOrderedAndProject(offset+limit)``: no full sort."""
    _check(page, limit)
    return df.orderBy(*order).offset((int(page) - 1) * int(limit)).limit(int(limit))


def load_more(df: DataFrame, pages: int, limit: int = 250, order=LISTING_ORDER) -> DataFrame:
    """Pages 1..``pages`` appended: the first ``pages*limit`` rows."""
    _check(pages, limit)
    return df.orderBy(*order).limit(int(pages) * int(limit))


def after(df: DataFrame, last_key: tuple, limit: int = 250, order=LISTING_ORDER) -> DataFrame:
    """Keyset page: the ``limit`` rows that follow ``last_key`` in ``order``.
    The lexicographic predicate reaches the scan as a pushed filter on the
    leading column, so deep pages cost one page, not ``offset`` rows."""
    _check(1, limit)
    if len(last_key) != len(order):
        raise ValueError("last_key must give one value per order column")
    cond = F.lit(False)
    eq = F.lit(True)
    for c, v in zip(order, last_key):
        cond = cond | (eq & (F.col(c) > F.lit(v)))
        eq = eq & (F.col(c) == F.lit(v))
    return df.filter(cond).orderBy(*order).limit(int(limit))


def has_more(total: int, page_no: int, limit: int) -> bool:
    """More pages exist while ``page < ceil(total/limit)``."""
    return int(page_no) < -(-int(total) // int(limit))
