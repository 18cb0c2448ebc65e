"""Bookmark, batch-search and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators import cards, feed, filters, saved, search, search_index
from jobgrid.plans.catalog import LISTING_COLS, register
from jobgrid.sources import fixtures as fx

L, S, R, U = fx.listings, fx.saved_jobs, fx.requests, fx.users

# Parameters of the registered queries (fixed test values).
FLAG_USER = 7  # the logged-in user whose bookmarks mark the listing page
VIEW = dict(location="asia|europe", type="3 Months", search="supplier")
PAGE_Q = "GEAR"
FEED_PER_USER = 250

_LC = ", ".join(f"l.{c}" for c in LISTING_COLS.split(", "))
_SAVED_LIST = f"SELECT s.user_id, {_LC} FROM saved_jobs s JOIN listings l ON s.job_id = l.job_id"


@register("saved_list", _SAVED_LIST, ("listings", "saved_jobs"))
def saved_list(spark, d):
    return saved.saved_list(L(spark, d), S(spark, d))


@register(
    "saved_flag",
    f"""SELECT {LISTING_COLS}, job_id IN (SELECT job_id FROM saved_jobs WHERE user_id = {FLAG_USER}) AS is_saved
        FROM listings""",
    ("listings", "saved_jobs"),
)
def saved_flag(spark, d):
    return cards.saved_flag(L(spark, d), S(spark, d), FLAG_USER)


@register(
    "saved_count",
    "SELECT user_id, count(*) AS n_saved FROM saved_jobs WHERE job_id IN (SELECT job_id FROM listings) GROUP BY user_id",
    ("listings", "saved_jobs"),
)
def saved_count(spark, d):
    return saved.saved_count(L(spark, d), S(spark, d))


_CHECKED = {
    "c": """SELECT r.request_id, r.ts, r.user_id, r.job_id, r.action,
              regexp_full_match(r.job_id, '[0-9a-fA-F]{24}') AS valid,
              l.job_id IS NOT NULL AS found, s.user_id IS NOT NULL AS pre
            FROM requests r LEFT JOIN (SELECT job_id FROM listings) l ON r.job_id = l.job_id
            LEFT JOIN saved_jobs s ON s.user_id = r.user_id AND s.job_id = r.job_id""",
}


_SERVED = {
    **_CHECKED,
    "e": """SELECT *, lag(action) OVER (PARTITION BY user_id, job_id ORDER BY ts, request_id) AS prev
            FROM c WHERE valid AND (action = 'unsave' OR found)""",
    "s": """SELECT c.request_id, c.user_id, c.job_id, c.action,
              CASE WHEN NOT c.valid THEN 'invalid_id' WHEN e.request_id IS NULL THEN 'not_found'
                   WHEN c.action = 'save' THEN CASE WHEN coalesce(e.prev = 'save', c.pre) THEN 'already_saved' ELSE 'created' END
                   WHEN coalesce(e.prev = 'save', c.pre) THEN 'removed' ELSE 'not_found' END AS status
            FROM c LEFT JOIN e ON c.request_id = e.request_id WHERE c.action IN ('save', 'unsave')""",
}


@register(
    "save_requests_classify",
    "SELECT request_id, user_id, job_id, status FROM s WHERE action = 'save'",
    ("listings", "saved_jobs", "requests"),
    _SERVED,
)
def save_requests_classify(spark, d):
    return saved.classify_saves(R(spark, d), L(spark, d), S(spark, d))


@register(
    "unsave_requests_classify",
    "SELECT request_id, user_id, job_id, status FROM s WHERE action = 'unsave'",
    ("listings", "saved_jobs", "requests"),
    _SERVED,
)
def unsave_requests_classify(spark, d):
    return saved.classify_unsaves(R(spark, d), L(spark, d), S(spark, d))


def apply_sql(actions: tuple[str, ...]) -> tuple[str, dict]:
    acts = ", ".join(f"'{a}'" for a in actions)
    ctes = {
        "v": f"""SELECT user_id, job_id, ts, request_id, action FROM requests r
                 WHERE action IN ({acts}) AND regexp_full_match(job_id, '[0-9a-fA-F]{{24}}')
                   AND (action = 'unsave' OR job_id IN (SELECT job_id FROM listings))""",
        "a": """SELECT user_id, job_id, arg_max(action, (ts, request_id)) AS last_action,
                  max(CASE WHEN action = 'unsave' THEN (ts, request_id) END) AS lu,
                  min(CASE WHEN action = 'save' THEN ts END) AS first_save
                FROM v GROUP BY user_id, job_id""",
        "fsa": """SELECT v.user_id, v.job_id, min(v.ts) AS fsa FROM v JOIN a USING (user_id, job_id)
                  WHERE v.action = 'save' AND a.lu IS NOT NULL AND (v.ts, v.request_id) > a.lu
                  GROUP BY v.user_id, v.job_id""",
    }
    sql = """SELECT s.user_id, s.job_id, s.saved_at FROM saved_jobs s
               WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = s.user_id AND a.job_id = s.job_id)
             UNION ALL
             SELECT a.user_id, a.job_id,
                    CASE WHEN a.lu IS NULL THEN coalesce(s.saved_at, a.first_save) ELSE f.fsa END AS saved_at
             FROM a LEFT JOIN fsa f USING (user_id, job_id)
                    LEFT JOIN saved_jobs s ON s.user_id = a.user_id AND s.job_id = a.job_id
             WHERE a.last_action = 'save'"""
    return sql, ctes


@register("apply_saves", *(lambda s, c: (s, ("listings", "saved_jobs", "requests"), c))(*apply_sql(("save",))))
def apply_saves(spark, d):
    return saved.apply_saves(S(spark, d), R(spark, d), L(spark, d))


@register("apply_unsaves", *(lambda s, c: (s, ("listings", "saved_jobs", "requests"), c))(*apply_sql(("unsave",))))
def apply_unsaves(spark, d):
    return saved.apply_unsaves(S(spark, d), R(spark, d), L(spark, d))


def _rx(col: str, p: str) -> str:
    return f"regexp_matches({col}, '{p}', 'i')"


@register(
    "saved_view_filter",
    f"""SELECT * FROM ({_SAVED_LIST}) x WHERE {_rx('location', VIEW['location'])}
          AND (CAST(NULL AS varchar) = '{VIEW['type']}' OR duration = '{VIEW['type']}')
          AND (contains(lower(title), '{VIEW['search']}') OR contains(lower(company), '{VIEW['search']}'))""",
    ("listings", "saved_jobs"),
)
def saved_view_filter(spark, d):
    return filters.saved_view_filter(saved.saved_list(L(spark, d), S(spark, d)), **VIEW).drop("type")


@register(
    "saved_page_search",
    f"""SELECT * FROM ({_SAVED_LIST}) x WHERE
          (title <> '' AND contains(lower(title), '{PAGE_Q.lower()}')) OR (company <> '' AND contains(lower(company), '{PAGE_Q.lower()}'))""",
    ("listings", "saved_jobs"),
)
def saved_page_search(spark, d):
    return filters.saved_page_search(saved.saved_list(L(spark, d), S(spark, d)), PAGE_Q)


@register(
    "saved_card",
    """SELECT job_id,
      coalesce(nullif(source, ''), 'Unknown') AS source_label,
      lower(coalesce(nullif(source, ''), 'Unknown')) AS source_class,
      upper(left(coalesce(nullif(company, ''), 'J'), 1)) AS initial,
      coalesce(nullif(title, ''), 'N/A') AS title_text,
      coalesce(nullif(company, ''), 'N/A') AS company_text,
      coalesce(nullif(location, ''), 'N/A') AS location_text,
      coalesce(nullif(duration, ''), 'N/A') AS tag,
      coalesce(nullif(stipend, ''), 'Not disclosed') AS pay,
      coalesce(job_url, '') <> '' AS can_apply,
      CASE coalesce(nullif(source, ''), 'Unknown') WHEN 'Internshala' THEN '#22c55e' WHEN 'Unstop' THEN '#f97316'
           WHEN 'Naukri' THEN '#38bdf8' WHEN 'Indeed' THEN '#f472b6' ELSE '#6c63ff' END AS colour
    FROM listings WHERE job_id IN (SELECT job_id FROM saved_jobs)""",
    ("listings", "saved_jobs"),
)
def saved_card(spark, d):
    lst = L(spark, d)
    live = lst.join(S(spark, d).select("job_id"), "job_id", "left_semi")
    return cards.saved_card(live)


@register(
    "search_batch",
    """SELECT r.request_id, r.q, h.results FROM requests r JOIN (
         SELECT q.q, CASE WHEN q.q = '' THEN (SELECT count(*) FROM listings) ELSE count(l.job_id) END AS results
         FROM (SELECT DISTINCT q FROM requests WHERE action = 'search') q
         LEFT JOIN listings l ON q.q <> '' AND (regexp_matches(l.title, q.q, 'i') OR regexp_matches(l.company, q.q, 'i')
                                               OR regexp_matches(l.location, q.q, 'i'))
         GROUP BY q.q) h ON r.q = h.q
       WHERE r.action = 'search'""",
    ("listings", "requests"),
)
def search_batch(spark, d):
    log = R(spark, d).filter(F.col("action") == "search")
    return search.search_batch(L(spark, d), log)


# a long log of patterns: one for each customer, most with text that a match must hold, some
# that can match anything
_PATTERNS = """CASE c_custkey % 8
  WHEN 0 THEN concat('supplier#0000', lpad(CAST(c_custkey % 211 AS string), 5, '0'), '$')
  WHEN 1 THEN concat('(red|blue) (gear|ring)|#0000', lpad(CAST(c_custkey % 97 AS string), 5, '0'))
  WHEN 2 THEN concat('^ *', lower(substr(c_mktsegment, 1, 4)), '|r#[0-9]*', lpad(CAST(c_custkey % 300 AS string), 3, '0'), '$')
  WHEN 3 THEN concat('er#0{3,}', CAST(c_custkey % 5 AS string))
  WHEN 4 THEN concat('0.', CAST(c_custkey % 10 AS string), '$')
  WHEN 5 THEN concat('no such ', CAST(c_custkey AS string))
  WHEN 6 THEN concat('asia|remote .', CAST(c_custkey % 60 AS string))
  ELSE concat('widget$|^ *hot.{', CAST(c_custkey % 9 AS string), '}r$') END"""


@register(
    "search_batch_indexed",
    f"""WITH log AS (SELECT c_custkey AS request_id, {_PATTERNS.replace(' AS string', ' AS varchar')} AS q FROM customer),
      v AS (SELECT title AS v FROM listings UNION SELECT company FROM listings UNION SELECT location FROM listings),
      m AS (SELECT q, v FROM (SELECT DISTINCT q FROM log) x, v WHERE v IS NOT NULL AND regexp_matches(v, q, 'i')),
      t AS (SELECT title, company, location, count(*) AS n FROM listings GROUP BY ALL),
      k AS (SELECT row_number() OVER () AS k, * FROM t),
      h AS (SELECT q, k, n FROM k JOIN m ON title = v UNION SELECT q, k, n FROM k JOIN m ON company = v
            UNION SELECT q, k, n FROM k JOIN m ON location = v),
      c AS (SELECT q, sum(n) AS results FROM h GROUP BY q)
    SELECT request_id, log.q, CAST(coalesce(results, 0) AS bigint) AS results FROM log LEFT JOIN c ON log.q = c.q""",
    ("listings",),
)
def search_batch_indexed(spark, d):
    """A log of as many patterns as customers, by the trigram index."""
    log = fx.read_table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.expr(_PATTERNS).alias("q"))
    return search_index.search_batch(L(spark, d), log)


@register(
    "user_feed",
    f"""SELECT u.user_id, rk.job_id, CAST(rk.feed_rank AS int) AS feed_rank FROM users u JOIN (
          SELECT * FROM (SELECT k, job_id, row_number() OVER (PARTITION BY k ORDER BY scraped_date, page, job_id) AS feed_rank
            FROM (SELECT job_id, scraped_date, page, duration AS k FROM listings WHERE coalesce(duration, '') <> ''
                  UNION ALL SELECT job_id, scraped_date, page, '*ALL*' FROM listings) c) x
          WHERE feed_rank <= {FEED_PER_USER}) rk
        ON rk.k = CASE WHEN coalesce(u.preferred_job_type, '') = '' THEN '*ALL*' ELSE u.preferred_job_type END""",
    ("listings", "users"),
)
def user_feed(spark, d):
    return feed.user_feed(U(spark, d), L(spark, d), FEED_PER_USER)
