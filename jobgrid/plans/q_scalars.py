"""Scalar-function queries, each applied over a whole table,
plus ``valid_object_id`` and the run report."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.functions import text as fn
from jobgrid.operators import aggregates as agg
from jobgrid.operators import merge, search
from jobgrid.plans.catalog import register, sql_dedupe_key, sql_strip
from jobgrid.plans.q_users import _TAGS
from jobgrid.sources import fixtures as fx
from jobgrid.sources import html as H

L, U, R = fx.listings, fx.users, fx.requests
_S = sql_strip


_TITLE0 = _S("coalesce(title, '')")
_COMPANY0 = _S("coalesce(company, '')")


@register(
    "fn_strip_lower",
    f"SELECT job_id, lower({_TITLE0}) AS title_key, lower({_COMPANY0}) AS company_key, "
    f"{sql_dedupe_key()} AS dedupe_key FROM listings",
    ("listings",),
)
def fn_strip_lower(spark, d):
    return L(spark, d).select(
        "job_id", fn.strip_lower("title").alias("title_key"), fn.strip_lower("company").alias("company_key"),
        merge.dedupe_key().alias("dedupe_key"),
    )


@register("fn_nonempty", "SELECT job_id, coalesce(nullif(stipend, ''), 'Not disclosed') AS pay FROM listings", ("listings",))
def fn_nonempty(spark, d):
    return L(spark, d).select("job_id", fn.nonempty("stipend", fn.CARD_NOT_DISCLOSED).alias("pay"))


@register(
    "fn_join_nonempty",
    "SELECT job_id, concat_ws(', ', nullif(company, ''), nullif(location, '')) AS who FROM listings",
    ("listings",),
)
def fn_join_nonempty(spark, d):
    return L(spark, d).select("job_id", fn.join_nonempty(["company", "location"]).alias("who"))


@register(
    "fn_strip_chars",
    "SELECT job_id, trim(', ' || location || ' ,', ', ') AS location_clean FROM listings",
    ("listings",),
)
def fn_strip_chars(spark, d):
    padded = F.concat(F.lit(", "), F.col("location"), F.lit(" ,"))
    return L(spark, d).select("job_id", fn.strip_chars(padded, ", ").alias("location_clean"))


@register(
    "fn_iso_date",
    "SELECT job_id, CASE WHEN page <> 1 THEN CAST(scraped_date AS varchar) ELSE 'N/A' END AS date_posted FROM listings",
    ("listings",),
)
def fn_iso_date(spark, d):
    iso = F.when(F.col("page") != 1, F.concat(F.col("scraped_date").cast("string"), F.lit("T08:00:00.000Z")))
    return L(spark, d).select("job_id", fn.iso_date(iso).alias("date_posted"))


_SAL = {
    "lo": "CASE WHEN page % 3 <> 0 THEN CAST(page * 1000 AS varchar) ELSE '0' END",
    "hi": "CASE WHEN page % 2 = 0 THEN CAST(page * 2000 AS varchar) END",
    "per": "CASE WHEN page <> 5 THEN ' / MONTH' ELSE '' END",
    "cur": "CASE WHEN page = 7 THEN 'USD' ELSE 'INR' END",
}


@register(
    "fn_salary_text",
    f"""SELECT job_id, CASE WHEN lo NOT IN ('', '0') AND hi IS NOT NULL THEN cur || ' ' || lo || ' - ' || hi || per
                       WHEN lo NOT IN ('', '0') THEN cur || ' ' || lo || per ELSE 'Not Disclosed' END AS stipend
        FROM (SELECT job_id, {_SAL['lo']} AS lo, {_SAL['hi']} AS hi, {_SAL['per']} AS per, {_SAL['cur']} AS cur FROM listings) x""",
    ("listings",),
)
def fn_salary_text(spark, d):
    p = F.col("page")
    lo = F.when(p % 3 != 0, (p * 1000).cast("string")).otherwise(F.lit("0"))
    hi = F.when(p % 2 == 0, (p * 2000).cast("string"))
    per = F.when(p != 5, F.lit("MONTH"))
    cur = F.when(p == 7, F.lit("USD"))
    return L(spark, d).select("job_id", fn.salary_text(lo, hi, per, cur).alias("stipend"))


@register(
    "fn_snippet",
    """SELECT job_id, CASE WHEN coalesce(x, '') <> '' THEN substr(x, 1, 300) || '...' ELSE 'N/A' END AS snippet
       FROM (SELECT job_id, title || repeat(' z', page * 40) AS x FROM listings) t""",
    ("listings",),
)
def fn_snippet(spark, d):
    x = F.concat(F.col("title"), F.repeat(F.lit(" z"), F.col("page") * 40))
    return L(spark, d).select("job_id", fn.snippet(x).alias("snippet"))


@register(
    "fn_absolute_url",
    """SELECT job_id, CASE WHEN x LIKE '/%' THEN 'https://internshala.com' || x ELSE x END AS url
       FROM (SELECT job_id, CASE WHEN page % 2 = 0 THEN '/internship/detail/' || job_id ELSE job_url END AS x FROM listings) t""",
    ("listings",),
)
def fn_absolute_url(spark, d):
    x = F.when(F.col("page") % 2 == 0, F.concat(F.lit("/internship/detail/"), "job_id")).otherwise(F.col("job_url"))
    return L(spark, d).select("job_id", fn.absolute_url(x, "https://internshala.com").alias("url"))


@register("fn_contains_ci", "SELECT job_id, title FROM listings WHERE contains(lower(title), 'gear')", ("listings",))
def fn_contains_ci(spark, d):
    return L(spark, d).filter(fn.contains_ci("title", "GEAR")).select("job_id", "title")


@register(
    "fn_initial",
    "SELECT job_id, upper(left(coalesce(nullif(company, ''), 'J'), 1)) AS initial FROM listings",
    ("listings",),
)
def fn_initial(spark, d):
    return L(spark, d).select("job_id", fn.initial("company").alias("initial"))


@register("fn_text_strip")
def fn_text_strip(spark, d):
    """Element text (each text node stripped, joined) of every article
    heading in ``pages``; no SQL equivalent of the text rule."""
    pages = fx.read_table(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    return H.html_cards(pages, "article", {"heading": H.Field(("h1",)), "para": H.Field(("p",))}, keys=["page_id"])


def _compact_sql(n: str) -> str:
    tenths = f"(({n} + 50) // 100)"
    return (
        f"CASE WHEN {n} >= 1000 THEN CAST({tenths} // 10 AS varchar) || "
        f"CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || CAST({tenths} % 10 AS varchar) END || 'K+' "
        f"ELSE CAST({n} AS varchar) END"
    )


@register(
    "fn_compact_count",
    f"""SELECT grp, n, {_compact_sql('n')} AS label FROM (
          SELECT source || '/' || CAST(page AS varchar) AS grp, count(*) AS n FROM listings GROUP BY source, page
          UNION ALL SELECT coalesce(company, '?'), count(*) FROM listings GROUP BY company) x""",
    ("listings",),
)
def fn_compact_count(spark, d):
    lst = L(spark, d)
    a = lst.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat("source", F.lit("/"), F.col("page").cast("string")).alias("grp"), "n"
    )
    b = lst.groupBy("company").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("company", F.lit("?")).alias("grp"), "n"
    )
    return a.unionByName(b).select("grp", "n", fn.compact_count("n").alias("label"))


@register("fn_tag_list", f"SELECT user_id, array_to_string({_TAGS}, '|') AS skills FROM users", ("users",))
def fn_tag_list(spark, d):
    return U(spark, d).select("user_id", F.array_join(fn.tag_list("skills_csv"), "|").alias("skills"))


@register(
    "fn_skill_add",
    f"""SELECT user_id, array_to_string(CASE WHEN list_contains(t, 'sql') THEN t ELSE list_append(t, 'sql') END, '|') AS skills
        FROM (SELECT user_id, CASE WHEN list_contains({_TAGS}, 'Python') THEN {_TAGS} ELSE list_append({_TAGS}, 'Python') END AS t
              FROM users) x""",
    ("users",),
)
def fn_skill_add(spark, d):
    s = fn.skill_add(fn.skill_add(fn.tag_list("skills_csv"), " Python "), "sql")
    return U(spark, d).select("user_id", F.array_join(s, "|").alias("skills"))


@register(
    "fn_skill_remove",
    f"SELECT user_id, array_to_string(list_filter({_TAGS}, lambda x: x <> 'sql'), '|') AS skills FROM users",
    ("users",),
)
def fn_skill_remove(spark, d):
    return U(spark, d).select("user_id", F.array_join(fn.skill_remove(fn.tag_list("skills_csv"), "sql"), "|").alias("skills"))


@register("fn_array_text", f"SELECT user_id, array_to_string({_TAGS}, ', ') AS skills_text FROM users", ("users",))
def fn_array_text(spark, d):
    return U(spark, d).select("user_id", fn.array_text(fn.tag_list("skills_csv")).alias("skills_text"))


_HITS = """SELECT q.q, CASE WHEN q.q = '' THEN (SELECT count(*) FROM listings) ELSE count(l.job_id) END AS results
         FROM (SELECT DISTINCT q FROM requests WHERE action = 'search') q
         LEFT JOIN listings l ON q.q <> '' AND (regexp_matches(l.title, q.q, 'i') OR regexp_matches(l.company, q.q, 'i')
                                               OR regexp_matches(l.location, q.q, 'i'))
         GROUP BY q.q"""


@register(
    "fn_search_log_line",
    """SELECT r.request_id, strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' SEARCH query="' || r.q || '" results='
              || CAST(h.results AS varchar) AS line
       FROM requests r JOIN hits h ON r.q = h.q WHERE r.action = 'search'""",
    ("listings", "requests"),
    {"hits": _HITS},
)
def fn_search_log_line(spark, d):
    log = R(spark, d).filter(F.col("action") == "search")
    hits = search.query_hits(L(spark, d), log)
    return log.join(hits, "q").select("request_id", fn.search_log_line("ts", "q", "results").alias("line"))


@register(
    "valid_object_id",
    "SELECT request_id, job_id, regexp_full_match(job_id, '[0-9a-fA-F]{24}') AS valid FROM requests",
    ("requests",),
)
def valid_object_id(spark, d):
    return R(spark, d).select("request_id", "job_id", fn.valid_object_id("job_id").alias("valid"))


_KEPT_N = f"""(SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY {sql_dedupe_key()}
              ORDER BY scraped_date, page, job_id) AS rn FROM listings) k WHERE rn = 1)"""


@register(
    "run_report",
    f"""SELECT source AS label, count(*) AS n FROM listings GROUP BY source
        UNION ALL SELECT 'Total Scraped', count(*) FROM listings
        UNION ALL SELECT 'Duplicates Removed', count(*) - {_KEPT_N} FROM listings
        UNION ALL SELECT 'Total Unique', {_KEPT_N}
        UNION ALL SELECT 'Actual Rows', {_KEPT_N}""",
    ("listings",),
)
def run_report(spark, d):
    return agg.dedupe_report(L(spark, d))
