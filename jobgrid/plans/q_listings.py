"""Listing queries: scan, filters, search, paging, counts, dedupe, merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobgrid.operators import aggregates as agg
from jobgrid.operators import cards, filters, merge, paging
from jobgrid.plans.catalog import LISTING_COLS, register, sql_dedupe_key
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx
from jobgrid.sources import keyed

# Parameters of the registered queries (fixed test values).
LIST_PARAMS = dict(source="Naukri", location="asia", search="red")
PAGE_SEARCH = "red"
PAGE_NO, PAGE_LIMIT = 2, 250
LOAD_MORE_SOURCE, LOAD_MORE_PAGES = "Unstop", 3
TITLE_COMPANY_RE = r"^c\+\+|supplier#0000000[1-3]"
SEARCH_Q = "asia"
SPLIT = "substr(job_id,1,1) < '8'"  # upsert fixture: target / batch split (FIXTURES B1)
WRITTEN = ["title", "company", "location", "source", "stipend", "duration", "job_url"]

L = fx.listings


def _rx(col: str, p: str) -> str:
    p = p.replace("'", "''")
    return f"regexp_matches({col}, '{p}', 'i')"


def _sel(where: str = "TRUE") -> str:
    return f"SELECT {LISTING_COLS} FROM listings WHERE {where}"


@register("scan_listings", _sel(), ("listings",))
def scan_listings(spark, d):
    return L(spark, d)


@register("filter_source", _sel("source = 'Indeed'"), ("listings",))
def filter_source(spark, d):
    return filters.list_filtered(L(spark, d), source="Indeed")


@register("filter_location", _sel(_rx("location", "remote")), ("listings",))
def filter_location(spark, d):
    return filters.list_filtered(L(spark, d), location="remote")


@register("filter_type", _sel("CAST(NULL AS varchar) = 'Permanent'"), ("listings",))
def filter_type(spark, d):
    # No source writes ``type``: the filter returns nothing (D2).
    return filters.list_filtered(L(spark, d), type="Permanent").drop("type")


@register(
    "filter_title_company",
    _sel(f"({_rx('title', TITLE_COMPANY_RE)} OR {_rx('company', TITLE_COMPANY_RE)})"),
    ("listings",),
)
def filter_title_company(spark, d):
    return filters.list_filtered(L(spark, d), search=TITLE_COMPANY_RE)


_LIST_WHERE = (
    f"source = 'Naukri' AND {_rx('location', 'asia')} AND ({_rx('title', 'red')} OR {_rx('company', 'red')})"
)


@register("list_filtered", _sel(_LIST_WHERE), ("listings",))
def list_filtered(spark, d):
    return filters.list_filtered(L(spark, d), **LIST_PARAMS)


@register(
    "search_3field",
    _sel(f"({_rx('title', SEARCH_Q)} OR {_rx('company', SEARCH_Q)} OR {_rx('location', SEARCH_Q)})"),
    ("listings",),
)
def search_3field(spark, d):
    return filters.search(L(spark, d), SEARCH_Q)


_RED = f"({_rx('title', PAGE_SEARCH)} OR {_rx('company', PAGE_SEARCH)})"


@register(
    "page_offset",
    _sel(_RED) + f" ORDER BY scraped_date, page, job_id LIMIT {PAGE_LIMIT} OFFSET {(PAGE_NO - 1) * PAGE_LIMIT}",
    ("listings",),
)
def page_offset(spark, d):
    return paging.page(filters.list_filtered(L(spark, d), search=PAGE_SEARCH), PAGE_NO, PAGE_LIMIT)


@register(
    "page_load_more",
    _sel(f"source = '{LOAD_MORE_SOURCE}'") + f" ORDER BY scraped_date, page, job_id LIMIT {LOAD_MORE_PAGES * PAGE_LIMIT}",
    ("listings",),
)
def page_load_more(spark, d):
    return paging.load_more(filters.list_filtered(L(spark, d), source=LOAD_MORE_SOURCE), LOAD_MORE_PAGES, PAGE_LIMIT)


_LAST = ("2024-02-01", 3, "8")  # key of the row that a client saw last


@register(
    "page_after",
    _sel(f"(scraped_date, page, job_id) > (DATE '{_LAST[0]}', {_LAST[1]}, '{_LAST[2]}')")
    + f" ORDER BY scraped_date, page, job_id LIMIT {PAGE_LIMIT}",
    ("listings",),
)
def page_after(spark, d):
    day, page_no, job = _LAST
    return paging.after(L(spark, d), (dt.date.fromisoformat(day), page_no, job), PAGE_LIMIT)


@register(
    "counts",
    "SELECT count(*) AS total, count(DISTINCT source) AS sources_count, "
    "array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM listings",
    ("listings",),
)
def counts(spark, d):
    return agg.counts(L(spark, d))


@register(
    "delete_report",
    "SELECT source, count(*) AS deleted FROM listings WHERE source IN ('Unstop', 'LinkedIn') GROUP BY source",
    ("listings",),
)
def delete_report(spark, d):
    return merge.delete_report(L(spark, d), "Unstop", "LinkedIn")


@register("count_total", "SELECT count(*) AS total FROM listings", ("listings",))
def count_total(spark, d):
    return agg.count_total(L(spark, d))


@register(
    "distinct_sources",
    "SELECT CAST(count(DISTINCT source) AS bigint) AS sources_count, "
    "array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM listings",
    ("listings",),
)
def distinct_sources(spark, d):
    return agg.distinct_sources(L(spark, d))


@register(
    "count_filtered",
    f"SELECT count(*) AS total, CAST(ceil(count(*) / {PAGE_LIMIT}.0) AS bigint) AS total_pages "
    f"FROM listings WHERE {_RED}",
    ("listings",),
)
def count_filtered(spark, d):
    return agg.count_filtered(filters.list_filtered(L(spark, d), search=PAGE_SEARCH), PAGE_LIMIT)


_DK = sql_dedupe_key()


@register(
    "dedupe_keys",
    f"""SELECT dedupe_key, count(*) AS n_rows, arg_min(job_id, ord) AS first_job_id FROM (
          SELECT {_DK} AS dedupe_key, job_id, (scraped_date, page, job_id) AS ord FROM listings) GROUP BY dedupe_key""",
    ("listings",),
)
def dedupe_keys(spark, d):
    return merge.dedupe_keys(L(spark, d))


_KEPT = f"""SELECT {LISTING_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {_DK}
          ORDER BY scraped_date, page, job_id) AS rn FROM listings) WHERE rn = 1"""


@register("dedupe_keep_first", _KEPT, ("listings",))
def dedupe_keep_first(spark, d):
    return merge.dedupe_keep_first(L(spark, d))


# ---- merges -------------------------------------------------------------------


def _split(spark, d):
    df = L(spark, d)
    return df.filter(F.substring("job_id", 1, 1) < "8"), df.filter(F.substring("job_id", 1, 1) >= "8")


def _sql_upsert(keys: list[str]) -> tuple[str, dict]:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in keys)
    ctes = {
        "t": f"SELECT * FROM listings WHERE {SPLIT}",
        "bt": f"SELECT * FROM listings WHERE NOT ({SPLIT})",
        "bl": f"""SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY scraped_date DESC, page DESC, job_id DESC) AS rl,
                  row_number() OVER (PARTITION BY {k} ORDER BY scraped_date, page, job_id) AS rf FROM bt""",
        "tf": f"""SELECT {k}, job_id AS tid FROM (SELECT *, row_number() OVER (PARTITION BY {k}
                  ORDER BY scraped_date, page, job_id) AS r FROM t) WHERE r = 1""",
        "bv": "SELECT * FROM bl WHERE rl = 1",
        "bf": "SELECT * FROM bl WHERE rf = 1",
        "upd": f"SELECT b.tid, {', '.join(f'a.{c} AS u_{c}' for c in WRITTEN)} FROM bv a JOIN tf b ON {on}",
        "ins": f"""SELECT f.job_id, {', '.join(f'a.{c}' for c in WRITTEN)}, f.scraped_date, f.page
                   FROM bv a JOIN bf f ON {on.replace('b.', 'f.')}
                   WHERE NOT EXISTS (SELECT 1 FROM tf b WHERE {on})""",
    }
    cols = ", ".join(f"CASE WHEN u.tid IS NOT NULL THEN u.u_{c} ELSE t.{c} END AS {c}" for c in WRITTEN)
    sql = f"""SELECT t.job_id, {cols}, t.scraped_date, t.page FROM t LEFT JOIN upd u ON t.job_id = u.tid
              UNION ALL SELECT job_id, {', '.join(WRITTEN)}, scraped_date, page FROM ins"""
    return sql, ctes


def _reg_upsert(key: str, keys: list[str]):
    sql, ctes = _sql_upsert(keys)

    @register(key, sql, ("listings",), ctes)
    def q(spark, d):
        t, b = _split(spark, d)
        return merge.upsert(t, b, keys).select(*LISTING_COLS.split(", "))

    return q


def _reg_keyed(key: str, keys: list[str]):
    sql, ctes = _sql_upsert(keys)

    @register(key, sql, ("listings",), ctes)
    def q(spark, d):
        """The same upsert into a table in key buckets, read back."""
        t, b = _split(spark, d)
        cols = LISTING_COLS.split(", ")
        table = keyed.KeyedTable(spark, scratch_path(spark, "keyed"), t.select(*cols).schema)
        table.create(t.select(*cols), buckets=16)
        keyed.upsert(table, b.select(*cols), keys)
        return table.read().select(*cols)

    return q


_reg_keyed("keyed_upsert_by_url", ["job_url"])
_reg_keyed("keyed_upsert_by_title_company", ["title", "company"])
_reg_keyed("keyed_upsert_by_title_company_url", ["title", "company", "job_url"])
_reg_upsert("upsert_by_url", ["job_url"])
_reg_upsert("upsert_by_title_company", ["title", "company"])
_reg_upsert("upsert_by_title_company_url", ["title", "company", "job_url"])

_UM_KEYS = ["title", "company", "job_url"]


@register(
    "upsert_match",
    f"""SELECT b.job_id AS batch_job_id, tf.tid AS target_job_id FROM bt b LEFT JOIN tf ON
        {' AND '.join(f'b.{c} IS NOT DISTINCT FROM tf.{c}' for c in _UM_KEYS)}""",
    ("listings",),
    {k: v for k, v in _sql_upsert(_UM_KEYS)[1].items() if k in ("t", "bt", "tf")},
)
def upsert_match(spark, d):
    t, b = _split(spark, d)
    return merge.upsert_match(t, b, _UM_KEYS)


@register(
    "replace_source",
    f"""SELECT {LISTING_COLS} FROM listings WHERE {SPLIT} AND source <> 'Indeed'
        UNION ALL SELECT {LISTING_COLS} FROM listings WHERE NOT ({SPLIT}) AND source = 'Indeed'""",
    ("listings",),
)
def replace_source(spark, d):
    t, b = _split(spark, d)
    return merge.replace_source(t, b.filter(F.col("source") == "Indeed"), "Indeed")


@register("delete_source", _sel("source NOT IN ('Unstop', 'LinkedIn')"), ("listings",))
def delete_source(spark, d):
    return merge.delete_source(L(spark, d), "Unstop", "LinkedIn")


# ---- display cards ----------------------------------------------------------

_CARD_SQL = """SELECT job_id,
  coalesce(nullif(source, ''), 'Unknown') AS source_label,
  lower(coalesce(nullif(source, ''), 'Unknown')) AS source_class,
  upper(left(coalesce(nullif(company, ''), 'J'), 1)) AS initial,
  coalesce(nullif(title, ''), 'N/A') AS title_text,
  coalesce(nullif(company, ''), 'N/A') AS company_text,
  coalesce(nullif(location, ''), 'N/A') AS location_text,
  concat_ws('|', nullif(CAST(NULL AS varchar), ''), nullif(duration, '')) AS tags,
  coalesce(nullif(stipend, ''), 'Not disclosed') AS pay,
  coalesce(job_url, '') <> '' AS can_apply,
  CASE coalesce(nullif(source, ''), 'Unknown') WHEN 'Internshala' THEN '#22c55e' WHEN 'Unstop' THEN '#f97316'
       WHEN 'Naukri' THEN '#38bdf8' WHEN 'Indeed' THEN '#f472b6' ELSE '#6c63ff' END AS colour,
  FALSE AS is_saved
FROM listings"""


@register("listing_card", _CARD_SQL, ("listings",))
def listing_card(spark, d):
    return cards.listing_card(L(spark, d))
