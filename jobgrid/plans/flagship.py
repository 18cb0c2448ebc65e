"""The flagship query: page 1 of the deduplicated listings matching a
title/company search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobgrid.operators import filters, merge, paging
from jobgrid.sources import fixtures as fx

FLAGSHIP_SEARCH = "red"


def flagship(spark: SparkSession, sf_dir: str, q: str = FLAGSHIP_SEARCH, page_no: int = 1, limit: int = 250) -> DataFrame:
    kept = merge.dedupe_keep_first(fx.listings(spark, sf_dir))
    return paging.page(filters.list_filtered(kept, search=q), page_no, limit)
