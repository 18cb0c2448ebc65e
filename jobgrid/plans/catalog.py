"""Registry of named queries: a Spark plan per key and, where one exists, the
DuckDB SQL that computes the same result from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobgrid.sources.fixtures import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB spelling of Python's str.strip() for the characters the fixtures plant.
def sql_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_dedupe_key(t: str = "title", c: str = "company") -> str:
    title = sql_strip("coalesce(" + t + ", '')")
    company = sql_strip("coalesce(" + c + ", '')")
    return f"concat(lower({title}), ' @ ', lower({company}))"


LISTING_COLS = "job_id, title, company, location, source, stipend, duration, job_url, scraped_date, page"


def register(key: str, oracle: str | None = None, fixtures: tuple[str, ...] = (), ctes: dict | None = None,
             stored: bool = False):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` under ``key``; the oracle
    SQL gets the named fixtures (and extra CTEs) prefixed as a WITH clause."""

    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_ctes(oracle, *fixtures, extra=ctes, stored=stored)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from jobgrid.plans import (  # noqa: F401
        q_emails,
        q_landing,
        q_listings,
        q_ranked,
        q_saved,
        q_saved_elements,
        q_scalars,
        q_signup,
        q_sinks,
        q_state,
        q_stream,
        q_users,
    )
