"""Test inputs derived from the given tables (FIXTURES.md part B).

Each fixture is one SQL text that runs unchanged in Spark SQL and in DuckDB.
Table names are written as ``{name}`` placeholders: Spark fills them with
DataFrames (``spark.sql(text, name=df)``, no global views), the DuckDB oracle
fills them with the pre-registered view names and pastes the text as a CTE.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from jobgrid.session import scratch_path, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_JOB_ID = (
    "substr(md5(concat_ws('|', CAST(l_orderkey AS string), CAST(l_linenumber AS string), "
    "CAST(l_partkey AS string), CAST(l_suppkey AS string), "
    "CAST(CAST(round(l_extendedprice*100) AS bigint) AS string), CAST(CAST(l_quantity AS int) AS string), "
    "CAST(CAST(l_shipdate AS date) AS string))),1,24)"
)

LISTINGS = f"""
SELECT {_JOB_ID} AS job_id,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN upper(p_name) WHEN l_orderkey % 7 = 1 THEN concat('  ', p_name, ' ')
       WHEN l_orderkey % 7 = 2 THEN concat(chr(9), p_name) WHEN l_orderkey % 97 = 3 THEN concat('C++ ', p_name) ELSE p_name END AS title,
  CASE WHEN l_suppkey % 50 = 49 THEN NULL WHEN l_suppkey % 50 = 48 THEN 'N/A' WHEN l_linenumber = 3 THEN lower(s_name) ELSE s_name END AS company,
  CASE WHEN n_nationkey % 5 = 0 THEN 'Remote' WHEN l_linenumber = 7 THEN NULL ELSE concat(n_name, ', ', r_name) END AS location,
  CASE l_partkey % 5 WHEN 0 THEN 'Internshala' WHEN 1 THEN 'Unstop' WHEN 2 THEN 'Naukri' WHEN 3 THEN 'Indeed' ELSE 'LinkedIn' END AS source,
  CASE l_partkey % 5 WHEN 0 THEN CASE WHEN l_linenumber = 1 THEN 'Unpaid' ELSE concat('INR ', CAST(CAST(l_quantity AS int)*500 AS string), ' /month') END
       WHEN 1 THEN 'Not Disclosed'
       WHEN 3 THEN CASE WHEN l_linenumber = 2 THEN '' ELSE concat('INR ', CAST(CAST(l_quantity AS int)*1000 AS string), ' - ', CAST(CAST(l_quantity AS int)*2000 AS string), ' / YEAR') END
       ELSE NULL END AS stipend,
  CASE l_partkey % 5 WHEN 0 THEN concat(CAST(l_linenumber AS string), ' Months') WHEN 1 THEN '3 Months' WHEN 3 THEN 'Permanent' ELSE NULL END AS duration,
  CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 59 = 0 THEN NULL ELSE concat('https://jobs.example.com/', CAST(l_partkey AS string), '/', CAST(l_suppkey AS string)) END AS job_url,
  CAST(l_shipdate AS date) AS scraped_date,
  l_linenumber AS page
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

_ORDER_JOB = f"""SELECT l_orderkey, min({_JOB_ID}) AS job_id
   FROM {{lineitem}} GROUP BY l_orderkey"""

SAVED_JOBS = f"""
SELECT user_id, job_id, min(ts) AS saved_at FROM (
 SELECT e.user_id, e.ts, coalesce(j.job_id, substr(md5(concat('missing', CAST(e.event_id AS string))),1,24)) AS job_id
 FROM {{events}} e LEFT JOIN (
   {_ORDER_JOB}) j ON e.event_id = j.l_orderkey
 WHERE e.event_type IN ('click','purchase')) y GROUP BY user_id, job_id
"""

USERS = """
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 29 = 0 THEN '   ' WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN concat(' ', c_name, ' ') ELSE c_name END AS name,
  CASE WHEN c_custkey % 17 = 0 THEN 'bad email' WHEN c_custkey % 37 = 0 THEN NULL
       ELSE concat(' User', CAST(CASE WHEN c_custkey % 40 = 1 THEN c_custkey - 1 ELSE c_custkey END AS string), '@Example.com') END AS email,
  CASE WHEN c_custkey % 19 = 0 THEN '12345' ELSE concat('9', lpad(CAST(c_custkey AS string), 9, '0')) END AS mobile,
  CAST(c_custkey % 12 AS int) AS password_length,
  CASE c_custkey % 23 WHEN 0 THEN 'student' WHEN 1 THEN NULL WHEN 2 THEN 'experienced' ELSE 'fresher' END AS work_status,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'B.Tech' END AS degree,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('College ', CAST(c_nationkey AS string)) END AS college,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE '2024' END AS grad_year,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_mktsegment, ' , sql,, ', lower(c_mktsegment), ',sql') END AS skills_csv,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('https://cv.example.com/', CAST(c_custkey AS string)) END AS resume_link,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Permanent' WHEN 2 THEN '3 Months' ELSE 'internship' END AS preferred_job_type
FROM {customer}
"""

REQUESTS = f"""
SELECT e.event_id AS request_id, e.ts, e.user_id,
  CASE e.event_type WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'unsave' ELSE 'search' END AS action,
  CASE WHEN e.event_id % 41 = 0 THEN 'not-an-id' WHEN j.job_id IS NULL THEN substr(md5(concat('missing', CAST(e.event_id AS string))),1,24) ELSE j.job_id END AS job_id,
  CASE e.event_id % 8 WHEN 0 THEN 'red' WHEN 1 THEN 'BOLT' WHEN 2 THEN 'supplier#00000000' WHEN 3 THEN 'remote' WHEN 4 THEN '' WHEN 5 THEN 'gear|ring' WHEN 6 THEN 'no such thing' ELSE 'asia' END AS q
FROM {{events}} e LEFT JOIN (
   {_ORDER_JOB}) j ON e.event_id - e.event_id % 3 = j.l_orderkey
"""

FIXTURES = {
    "listings": (LISTINGS, ("lineitem", "part", "supplier", "nation", "region")),
    "saved_jobs": (SAVED_JOBS, ("events", "lineitem")),
    "users": (USERS, ("customer",)),
    "requests": (REQUESTS, ("events", "lineitem")),
}


# Tables small enough to stay one partition (joined by broadcast anyway).
_DIMENSIONS = {"region", "nation", "supplier", "part", "customer", "benchmark", "labels"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if name in _DIMENSIONS else spread(df)


def fixture_plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture as a lazy DataFrame over the raw tables."""
    text, deps = FIXTURES[name]
    return spark.sql(text, **{t: read_table(spark, sf_dir, t) for t in deps})


# Listings are stored like the product's snapshot: partitioned by source.
_PARTITION_BY = {"listings": "source"}
_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, key: tuple, build, partition_by: str | None = None) -> DataFrame:
    """Materialise ``build()`` once per session into the shared folder and
    read it back: a table derived from the given tables, written the way the
    engine stores its own tables (several files, optionally partitioned).

    Each task writes what it has: dealing the finished rows out once more would
    shuffle, sort and spill the whole table, on as many tasks as cores."""
    k = (spark.sparkContext.applicationId, *key)
    path = _STORED.get(k)
    if path is None:
        path = scratch_path(spark, "table-" + "-".join(str(x).strip("/").replace("/", "_") for x in key))
        w = build().write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        _STORED[k] = path
    return spark.read.parquet(path)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture, materialised once per session (see ``stored``)."""
    plan = fixture_plan(spark, sf_dir, name)
    cols = plan.columns
    return stored(spark, ("fx", sf_dir, name), lambda: plan, _PARTITION_BY.get(name)).select(*cols)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "listings")


def saved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "saved_jobs")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "users")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "requests")


@lru_cache(maxsize=None)
def cte(name: str) -> str:
    """The fixture as a DuckDB CTE body (table placeholders → view names)."""
    text, deps = FIXTURES[name]
    return text.format(**{t: t for t in deps})


def with_ctes(sql: str, *names: str, extra: dict[str, str] | None = None, stored: bool = False) -> str:
    """Prefix ``sql`` with the fixtures it reads, plus extra named CTEs, each
    computed once when ``stored`` (a long chain of steps)."""
    once = "AS MATERIALIZED" if stored else "AS"
    parts = [f"{n} {once} ({cte(n)})" for n in names]
    parts += [f"{k} {once} ({v})" for k, v in (extra or {}).items()]
    body = sql.lstrip()
    if parts and body[:5].upper() == "WITH ":  # merge the query's own CTEs
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
