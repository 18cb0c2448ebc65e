"""Saved elements with their payload: a batch of saves and unsaves in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators import saved_elements
from jobgrid.plans.catalog import register
from jobgrid.sources import fixtures as fx

# one id an element, so that each id of a user is a lag over its own requests;
# elements that name several ids are held against a row-at-a-time model in the tests
_OLD = """CASE WHEN substr(job_id, 24, 1) < '5' THEN concat('"', job_id, '"')
  WHEN substr(job_id, 24, 1) < 'a' THEN concat('{"jobId":"', job_id, '","note":{"day":"', CAST(CAST(saved_at AS date) AS string), '"}}')
  ELSE concat('{"id":"', job_id, '"}') END"""
_BODY = """CASE request_id % 6 WHEN 0 THEN concat('"', job_id, '"') WHEN 1 THEN concat('{"id":"', job_id, '","title":"', q, '"}')
  WHEN 2 THEN concat('{"title":"', q, '"}') WHEN 3 THEN concat('{"_id":"', job_id, '","title":"', q, '"}')
  ELSE concat('{"jobId":"', job_id, '","title":"', q, '"}') END"""
_sql = lambda x: x.replace("AS string", "AS varchar")

_CTES = {
    "rq": f"SELECT request_id, ts, user_id, action, job_id, request_id % 6 AS k, {_sql(_BODY)} AS e FROM requests WHERE action IN ('save', 'unsave')",
    # per user and id, in time: what was there, then the requests; a body without a checked id is never refused
    "ev": f"""SELECT user_id, job_id, 0 AS part, saved_at AS ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY saved_at, job_id) AS bigint) AS n, 'there' AS action, 0 AS k, {_sql(_OLD)} AS e FROM saved_jobs
              UNION ALL SELECT user_id, job_id, 1, ts, request_id, action, k, e FROM rq WHERE action = 'unsave' OR k <> 2""",
    # live elements with a checked id before a request: the last save of one or unsave decides
    "st": """SELECT *,
               max(CASE WHEN action = 'unsave' THEN (part, ts, n) END) OVER w AS cleared,
               max(CASE WHEN action <> 'unsave' AND NOT (action = 'save' AND k = 3) THEN (part, ts, n) END) OVER w AS held,
               max(CASE WHEN action <> 'unsave' THEN (part, ts, n) END) OVER w AS there
             FROM ev WINDOW w AS (PARTITION BY user_id, job_id ORDER BY part, ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "said": """SELECT *, CASE WHEN action = 'there' THEN 'there'
               WHEN action = 'save' THEN CASE WHEN k <> 3 AND held IS NOT NULL AND (cleared IS NULL OR held > cleared) THEN 'already_saved' ELSE 'created' END
               WHEN there IS NOT NULL AND (cleared IS NULL OR there > cleared) THEN 'removed' ELSE 'not_found' END AS status FROM st""",
    "gone": "SELECT user_id, job_id, max((part, ts, n)) AS last FROM ev WHERE action = 'unsave' GROUP BY user_id, job_id",
    "live": """SELECT s.user_id, s.part, s.ts, s.n, s.e FROM said s LEFT JOIN gone g ON s.user_id = g.user_id AND s.job_id = g.job_id
               WHERE s.status IN ('there', 'created') AND (g.last IS NULL OR (s.part, s.ts, s.n) > g.last)
               UNION ALL SELECT user_id, 1, ts, request_id, e FROM rq WHERE action = 'save' AND k = 2""",
}


def _applied(spark, d):
    s = fx.saved_jobs(spark, d)
    # the place of an element in its user's array, which stands in time and id order
    place = "row_number() OVER (PARTITION BY user_id ORDER BY saved_at, job_id)"
    there = s.selectExpr("user_id", "CAST(0 AS bigint) AS batch", "saved_at AS ts", f"CAST({place} AS bigint) AS n", f"parse_json({_OLD}) AS element")
    r = fx.requests(spark, d).filter(F.col("action").isin("save", "unsave"))
    asked = r.selectExpr("user_id", "ts", "request_id", "action", f"CASE WHEN action = 'save' THEN parse_json({_BODY}) END AS body", "job_id AS target")
    return saved_elements.apply(there, asked, 1)


@register(
    "saved_elements",
    """SELECT user_id, CAST(count(*) AS int) AS n_saved, '[' || string_agg(e, ',' ORDER BY part, ts, n) || ']' AS saved FROM live GROUP BY user_id""",
    ("saved_jobs", "requests"),
    _CTES,
    stored=True,
)
def saved_elements_after(spark, d):
    """Every user's array with its payloads, after the requests."""
    return saved_elements.arrays(_applied(spark, d)[0])


@register(
    "saved_element_requests",
    """SELECT n AS request_id, status FROM said WHERE status <> 'there' UNION ALL SELECT request_id, 'created' FROM rq WHERE action = 'save' AND k = 2""",
    ("saved_jobs", "requests"),
    _CTES,
    stored=True,
)
def saved_element_requests(spark, d):
    return _applied(spark, d)[1]
