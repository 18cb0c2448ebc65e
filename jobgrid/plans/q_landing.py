"""Landing-page queries: page window, page policy, JSON and HTML scans, the
per-source normalisers, unification and page statistics.

Spark side: landing bodies are built from the listing fixture and read back
through the real scan path.  Oracle side: the expected rows come straight
from the raw tables (never through the JSON or HTML)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators import aggregates as agg
from jobgrid.operators import normalize as N
from jobgrid.plans.catalog import register, sql_strip
from jobgrid.sources import fixtures as fx
from jobgrid.sources import html as H
from jobgrid.sources.landing import LANDING_SCHEMA, build_landing, outside_window, scan_landing, source_config

SOURCES = ("Internshala", "Unstop", "Naukri", "Indeed", "LinkedIn")


def landing_pages(spark, d):
    """Landing pages derived from the listing fixture, stored once per session
    like crawler output (Parquet partitioned by source)."""
    return fx.stored(spark, ("landing", d), lambda: build_landing(fx.listings(spark, d)), "source").select(
        *LANDING_SCHEMA.fieldNames()
    )


def landing(spark, d):
    """All landed pages."""
    return scan_landing(landing_pages(spark, d), source_config(spark))


def _ts(df):
    return df.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"))


# ---- oracle CTEs --------------------------------------------------------------------

_LAND = {
    "sk": """SELECT CASE WHEN n <= g * 25 THEN 0 WHEN n <= g * 25 * 16 THEN 1 WHEN n <= g * 25 * 256 THEN 2 ELSE 3 END AS k
             FROM (SELECT count(*) AS n, count(DISTINCT (source, substr(CAST(scraped_date AS varchar), 1, 7), page)) AS g
                   FROM listings) c""",
    "lr0": """SELECT l.*, concat(substr(CAST(scraped_date AS varchar), 1, 7), '/', substr(job_id, 1, sk.k)) AS run_id
              FROM listings l, sk""",
    "lr": "SELECT *, min(scraped_date) OVER (PARTITION BY run_id, source, page) AS run_day FROM lr0",
    "win": "SELECT DISTINCT run_id, source, page, CASE WHEN page = 4 THEN 500 ELSE 200 END AS status FROM lr",
    "bad": """SELECT *, (page = 4 OR (source = 'Naukri' AND page = 2 AND run_id LIKE '%-03/%')) AS bad FROM win""",
    "fb": """SELECT run_id, source, min(page) AS stop FROM bad WHERE bad AND source IN ('Indeed', 'LinkedIn')
             GROUP BY run_id, source""",
    "kept": """SELECT b.run_id, b.source, b.page, b.status FROM bad b LEFT JOIN fb USING (run_id, source)
               WHERE CASE WHEN b.source IN ('Indeed', 'LinkedIn') THEN fb.stop IS NULL OR b.page < fb.stop
                          ELSE NOT b.bad END""",
    "kp": """SELECT lr.*, CAST(row_number() OVER (PARTITION BY lr.run_id, lr.source, lr.page ORDER BY lr.job_id) - 1 AS int) AS pos
             FROM lr JOIN kept USING (run_id, source, page)""",
}

_NULL = "CAST(NULL AS varchar)"
_DAY = "CAST(scraped_date AS varchar)"
_AT = "CAST(run_day AS varchar) || ' 06:00:00' AS scraped_at"


def _cols(job_url: str, title="title", company="company", location="location", stipend=_NULL, duration=_NULL,
          link=_NULL, date_posted=_NULL, description=_NULL, snippet=_NULL, source="''") -> str:
    return (
        f"job_id, run_id, page, pos, {title} AS title, {company} AS company, {location} AS location, "
        f"{stipend} AS stipend, {duration} AS duration, {job_url} AS job_url, {link} AS link, "
        f"{date_posted} AS date_posted, {description} AS description, {snippet} AS job_description_snippet, "
        f"{source} AS source, {_AT}"
    )


_NAUKRI = "SELECT " + _cols(
    "job_url", date_posted=f"{_DAY} || 'T00:00:00Z'", description="'Role: ' || title", source="'Naukri'"
) + " FROM kp WHERE source = 'Naukri'"

_UNSTOP_URL = "CASE WHEN coalesce(job_url, '') <> '' THEN 'https://unstop.com/jobs/' || job_id ELSE 'https://unstop.com' END"
_UNSTOP = "SELECT " + _cols(
    _UNSTOP_URL,
    company="CASE WHEN page = 3 THEN 'N/A' ELSE coalesce(company, 'N/A') END",
    location="""CASE WHEN page IN (1, 2) THEN coalesce(nullif(location, ''), 'Remote') WHEN location IS NULL THEN 'Remote'
                ELSE trim(concat(split_part(location, ', ', 1), ', , ', split_part(location, ', ', 2)), ', ') END""",
    stipend="coalesce(nullif(stipend, ''), 'Not Disclosed')",
    duration="CASE WHEN page % 2 = 0 THEN 'Permanent' ELSE '3 Months' END",
    link=_UNSTOP_URL,
    source="'Unstop'",
) + " FROM kp WHERE source = 'Unstop' AND coalesce(title, '') <> ''"

_IND = {
    "ind": """SELECT *,
        CASE WHEN page <> 2 THEN split_part(location, ', ', 1) END AS city,
        CASE WHEN page IN (1, 5) THEN split_part(location, ', ', 2) END AS state,
        CASE WHEN page = 3 THEN 'IN' ELSE 'India' END AS country,
        CASE WHEN page = 7 THEN NULL WHEN page = 6 THEN 0 ELSE page * 100000 END AS lo,
        CASE WHEN page IN (1, 2, 5) THEN page * 150000 END AS hi,
        CASE WHEN page <> 2 THEN ' / YEAR' ELSE '' END AS per,
        CASE WHEN page = 5 THEN 'USD' ELSE 'INR' END AS cur,
        'Build ' || title || ' ' || repeat('x', page * 60) AS descr
      FROM kp WHERE source = 'Indeed'""",
}
_INDEED = "SELECT " + _cols(
    "coalesce(job_url, 'N/A')",
    title="coalesce(title, 'N/A')",
    company="coalesce(company, 'N/A')",
    location="""CASE WHEN concat_ws(', ', nullif(city, ''), nullif(state, '')) <> ''
                THEN concat_ws(', ', nullif(city, ''), nullif(state, '')) ELSE country END""",
    stipend="""CASE WHEN coalesce(lo, 0) <> 0 AND coalesce(hi, 0) <> 0
                    THEN cur || ' ' || CAST(lo AS varchar) || ' - ' || CAST(hi AS varchar) || per
                    WHEN coalesce(lo, 0) <> 0 THEN cur || ' ' || CAST(lo AS varchar) || per
                    ELSE 'Not Disclosed' END""",
    duration="'Permanent'",
    date_posted=f"CASE WHEN page <> 6 THEN {_DAY} ELSE 'N/A' END",
    snippet="CASE WHEN coalesce(descr, '') <> '' THEN substr(descr, 1, 300) || '...' ELSE 'N/A' END",
    source="'Indeed'",
) + " FROM ind"

_INTERN_URL = "CASE WHEN coalesce(job_url, '') = '' THEN '' ELSE 'https://internshala.com/internship/detail/' || job_id END"
_INTERNSHALA = "SELECT " + _cols(
    _INTERN_URL,
    title=sql_strip("title"),
    company=f"CASE WHEN company IS NULL THEN 'N/A' ELSE {sql_strip('company')} END",
    location=f"CASE WHEN location IS NULL THEN 'Remote' ELSE {sql_strip('location')} END",
    stipend=sql_strip("stipend"),
    duration=f"CASE WHEN page = 1 THEN '3 Months' ELSE {sql_strip('duration')} END",
    link=_INTERN_URL,
    source="'Internshala'",
) + " FROM kp WHERE source = 'Internshala' AND title IS NOT NULL"

_LINKEDIN = "SELECT " + _cols(
    "coalesce(job_url, '')",
    title=f"CASE WHEN title IS NULL THEN 'N/A' ELSE {sql_strip('title')} END",
    company=f"CASE WHEN company IS NULL THEN 'N/A' ELSE {sql_strip('company')} END",
    location=f"CASE WHEN location IS NULL THEN 'N/A' ELSE {sql_strip('location')} END",
    source="'LinkedIn'",
) + " FROM kp WHERE source = 'LinkedIn'"

_EXPECTED = {"Naukri": _NAUKRI, "Unstop": _UNSTOP, "Indeed": _INDEED, "Internshala": _INTERNSHALA, "LinkedIn": _LINKEDIN}
_ALL_CTES = {**_LAND, **_IND}
_UNION = " UNION ALL ".join(f"({_EXPECTED[s]})" for s in SOURCES)


@register("scan_landing", "SELECT run_id, source, page, status FROM win", ("listings",), _LAND)
def q_scan_landing(spark, d):
    return landing(spark, d).select("run_id", "source", "page", "status")


_WINDOW = """page <= CASE source WHEN 'Internshala' THEN 5 WHEN 'Unstop' THEN 10 WHEN 'Naukri' THEN 5
             WHEN 'Indeed' THEN 25 ELSE page END"""


@register("scan_landing_window", f"SELECT run_id, source, page, status FROM win WHERE {_WINDOW}", ("listings",), _LAND)
def q_scan_landing_window(spark, d):
    return scan_landing(landing_pages(spark, d), source_config(spark), window=True).select("run_id", "source", "page", "status")


@register("landing_outside_window", f"SELECT run_id, source, page, 'outside the page window' AS reason FROM win WHERE NOT ({_WINDOW})", ("listings",), _LAND)
def q_outside_window(spark, d):
    return outside_window(landing_pages(spark, d), source_config(spark)).select("run_id", "source", "page", "reason")


@register("page_policy", "SELECT run_id, source, page, status FROM kept", ("listings",), _LAND)
def q_page_policy(spark, d):
    from jobgrid.sources.landing import page_policy

    return page_policy(N.page_flags(landing(spark, d)), source_config(spark)).select("run_id", "source", "page", "status")


def _scan_json(source: str):
    @register(
        f"scan_json_{source.lower()}",
        f"SELECT run_id, source, page, pos, job_id FROM kp WHERE source = '{source}'",
        ("listings",),
        _LAND,
    )
    def q(spark, d):
        recs = N.json_records(landing(spark, d), source, source_config(spark))
        return recs.select("run_id", "source", "page", "pos", N.vget(F.col("rec"), "$.id").alias("job_id"))

    return q


for _s in ("Unstop", "Naukri", "Indeed"):
    _scan_json(_s)


@register(
    "scan_html_cards",
    """SELECT page_id, CAST(unnest(range(len(h))) AS int) AS pos, unnest(h) AS href, unnest(t) AS text FROM (
         SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h,
                regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)""",
)
def scan_html_cards(spark, d):
    pages = fx.read_table(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    fields = {"href": H.Field(("a",), "attr", "href"), "text": H.Field(("a",))}
    return H.html_cards(pages, "nav li", fields, keys=["page_id"])


@register(
    "scan_html_cards_linkedin",
    f"""SELECT run_id, page, pos, job_id AS ref, {sql_strip('title')} AS title, {sql_strip('company')} AS company,
          {sql_strip('location')} AS location, job_url AS href FROM kp WHERE source = 'LinkedIn'""",
    ("listings",),
    _LAND,
)
def scan_html_cards_linkedin(spark, d):
    cards = N.html_records(landing(spark, d), "LinkedIn", source_config(spark), N.LINKEDIN_CARD, N.LINKEDIN_FIELDS)
    return cards.select("run_id", "page", "pos", "ref", "title", "company", "location", "href")


def _norm(source: str):
    @register(f"norm_{source.lower()}", _EXPECTED[source], ("listings",), _ALL_CTES)
    def q(spark, d):
        return _ts(N.normalize(landing(spark, d), source, source_config(spark))[0])

    return q


for _s in SOURCES:
    _norm(_s)


def _unified(spark, d):
    lnd = landing(spark, d)
    cfg = source_config(spark)
    return N.unify(*[N.normalize(lnd, s, cfg)[0] for s in SOURCES])


@register(
    "norm_scraped_at",
    f"SELECT source, run_id, page, pos, scraped_at FROM ({_UNION}) u",
    ("listings",),
    _ALL_CTES,
)
def norm_scraped_at(spark, d):
    return _ts(_unified(spark, d)).select("source", "run_id", "page", "pos", "scraped_at")


@register("unify_sources", f"SELECT * FROM ({_UNION}) u", ("listings",), _ALL_CTES)
def unify_sources(spark, d):
    return _ts(_unified(spark, d))


@register(
    "source_union",
    f"SELECT source, title, company, location, job_url FROM ({_UNION}) u",
    ("listings",),
    _ALL_CTES,
)
def source_union(spark, d):
    return _unified(spark, d).select("source", "title", "company", "location", "job_url")


@register(
    "page_stats",
    f"SELECT source, page, count(*) AS n_records FROM ({_UNION}) u GROUP BY source, page",
    ("listings",),
    _ALL_CTES,
)
def page_stats(spark, d):
    return agg.page_stats(_unified(spark, d))
