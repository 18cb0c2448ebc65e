"""Email changes over the users: chains, swaps, a hot email, own emails."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators.email_changes import email_changes
from jobgrid.plans.catalog import register, sql_strip
from jobgrid.sources import fixtures as fx

# (step, which users by c_custkey k, the email asked for): users 0 to 4 of ten move up by one
# each after the fourth made room, and once more in the wrong order; 6 and 7 swap by way of a third
_STEPS = (
    ("k % 10 = 4", "concat('fresh', CAST(k AS string), '@example.com')"),
    ("k % 10 = 3", "concat(' USER', CAST(k + 1 AS string), '@Example.com ')"),
    ("k % 10 = 2", "concat('user', CAST(k + 1 AS string), '@example.com')"),
    ("k % 10 < 2", "concat('user', CAST(k + 1 AS string), '@example.com')"),
    ("k % 10 IN (6, 7)", "concat('user', CAST(CASE WHEN k % 10 = 6 THEN k + 1 ELSE k - 1 END AS string), '@example.com')"),
    ("k % 10 = 7", "concat('between', CAST(k AS string), '@example.com')"),
    ("k % 10 = 6", "concat('user', CAST(k + 1 AS string), '@example.com')"),
    ("k % 10 = 7", "concat('user', CAST(k - 1 AS string), '@example.com')"),
    ("k % 3 = 0", "'hot@example.com'"),
    ("k % 3 = 0 AND k % 2 = 0", "concat('user', CAST(k AS string), '@example.com')"),
    ("k % 5 = 1", "CASE WHEN k % 2 = 0 THEN '  ' WHEN k % 3 = 0 THEN NULL ELSE 'hot@example.com' END"),
    ("k % 50 = 0", "'hot@example.com'"),
)
REQUESTS = " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS bigint) * 1000000000 + k AS request_id, k + CASE WHEN k % 97 = 0 THEN 1000000 ELSE 0 END AS user_id, "
    f"{email} AS email FROM (SELECT CAST(c_custkey AS bigint) AS k FROM {{customer}}) c WHERE {who}"
    for i, (who, email) in enumerate(_STEPS)
)
_NORM = f"lower({sql_strip('email')})"

# one by one: a step a request, the emails of all users carried along as a map
_ORACLE_CTES = {
    "asked": REQUESTS.format(customer="customer").replace("AS string", "AS varchar"),
    "r": f"SELECT *, {_NORM} AS e, row_number() OVER (ORDER BY request_id) AS n FROM asked",
}
_WALK = f"""
  SELECT CAST(0 AS bigint) AS n, map(list(CAST(user_id AS bigint) ORDER BY user_id), list({_NORM} ORDER BY user_id)) AS m,
    CAST(NULL AS bigint) AS request_id, CAST(NULL AS bigint) AS user_id, CAST(NULL AS varchar) AS e, CAST(NULL AS varchar) AS status
  FROM users
  UNION ALL
  SELECT n, CASE WHEN status = 'changed' THEN map_concat(m, map([user_id], [e])) ELSE m END, request_id, user_id, e, status
  FROM (SELECT r.n, w.m, r.request_id, r.user_id, r.e,
      CASE WHEN NOT map_contains(w.m, r.user_id) THEN 'no_user' WHEN coalesce(r.e, '') = '' THEN 'unchanged'
           WHEN w.m[r.user_id] = r.e THEN 'unchanged' WHEN list_contains(map_values(w.m), r.e) THEN 'in_use'
           ELSE 'changed' END AS status
    FROM walk w JOIN r ON r.n = w.n + 1) x"""


def _sql(select: str) -> str:
    ctes = ", ".join(f"{k} AS ({v})" for k, v in {"users": fx.cte("users"), **_ORACLE_CTES}.items())
    return f"WITH RECURSIVE {ctes}, walk AS ({_WALK}) {select}"


def _changes(spark, d):
    users = fx.users(spark, d)
    reqs = spark.sql(REQUESTS, customer=fx.read_table(spark, d, "customer"))
    return email_changes(users.withColumn("user_id", F.col("user_id").cast("long")), reqs, order=F.col("request_id"))


def email_change_statuses(spark, d):
    """Status of each request, as if served one by one."""
    return _changes(spark, d)[0]


def email_change_users(spark, d):
    """The users' emails after all requests."""
    return _changes(spark, d)[1].select("user_id", F.lower(F.trim("email")).alias("email_norm"))


register("email_change_statuses", _sql("SELECT request_id, user_id, e AS email_norm, status FROM walk WHERE n > 0"))(email_change_statuses)
register("email_change_users", _sql("""SELECT u.k AS user_id, w.m[u.k] AS email_norm FROM (SELECT * FROM walk ORDER BY n DESC LIMIT 1) w,
  (SELECT unnest(map_keys((SELECT m FROM walk WHERE n = 0))) AS k) u"""))(email_change_users)
