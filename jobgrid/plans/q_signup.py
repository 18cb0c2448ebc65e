"""Users after a batch of sign-ups and third-party sign-ins, and the twelve-field
completion score over users who have all twelve fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.functions.text import tag_list
from jobgrid.operators import users as ops
from jobgrid.plans.catalog import register, sql_strip
from jobgrid.plans.q_users import _FAILED, _TAGS, SPLIT
from jobgrid.sources import fixtures as fx

U = fx.users
_S = sql_strip
_EMAIL = f"lower({_S('email')})"

_CTES = {
    "ex": f"SELECT * FROM users WHERE {SPLIT}",
    "bt": f"SELECT *, {_EMAIL} AS email_norm, {_FAILED} AS failed FROM users WHERE NOT ({SPLIT})",
    "taken": f"SELECT DISTINCT {_EMAIL} AS email_norm FROM ex WHERE email IS NOT NULL",
    "fst": "SELECT email_norm, min(user_id) AS fid FROM bt WHERE failed = '' GROUP BY email_norm",
    "decided": """SELECT bt.*, CASE WHEN failed <> '' THEN 'invalid:' || failed
                              WHEN t.email_norm IS NOT NULL THEN 'email_exists'
                              WHEN bt.user_id <> fst.fid THEN 'email_exists' END AS reason
            FROM bt LEFT JOIN taken t ON bt.email_norm = t.email_norm LEFT JOIN fst ON bt.email_norm = fst.email_norm""",
}
_DEFAULTED = ["college", "degree", "grad_year", "resume_link", "preferred_job_type"]
_ABSENT = ["location", "gender", "dob", "bio", "availability"]
_OUT = ["user_id", "name", "email", "mobile", "password_length", "work_status", "experience_level", *_DEFAULTED, *_ABSENT, "email_notifications"]
_LISTS = [c for c in ops.EMPTY_LISTS if c != "skills"]
_OLD_ROWS = f"""SELECT user_id, name, email, mobile, password_length, work_status, CAST(NULL AS varchar) AS experience_level, {', '.join(_DEFAULTED)},
  {', '.join(f'CAST(NULL AS varchar) AS {c}' for c in _ABSENT)}, CAST(NULL AS boolean) AS email_notifications,
  array_to_string({_TAGS}, '|') AS skills, CAST(NULL AS int) AS n_empty_lists, FALSE AS stamped FROM {{rows}}"""
_NEW_TAIL = f"""'Fresher' AS experience_level, {', '.join(f"'' AS {c}" for c in _DEFAULTED + _ABSENT)}, TRUE AS email_notifications,
  '' AS skills, {len(_LISTS)} AS n_empty_lists, TRUE AS stamped"""


def _shown(users):
    empty = sum((F.size(c) == 0).cast("int") for c in _LISTS)
    stamped = F.col("created_at").isNotNull() & (F.col("created_at") == F.col("updated_at"))
    return users.select(*_OUT, F.array_join("skills", "|").alias("skills"), empty.alias("n_empty_lists"), F.coalesce(stamped, F.lit(False)).alias("stamped"))


def _parts(spark, d):
    u = U(spark, d)
    split = F.substring(F.md5(F.col("user_id").cast("string")), 1, 1) < "8"
    return u.filter(split).withColumn("skills", tag_list("skills_csv")).drop("skills_csv"), u.filter(~split)


@register(
    "signup_users",
    f"""{_OLD_ROWS.format(rows='ex')} UNION ALL
        SELECT user_id, {_S('name')}, email_norm, {_S('mobile')}, password_length, coalesce(nullif(work_status, ''), 'fresher'), {_NEW_TAIL}
        FROM decided WHERE reason IS NULL""",
    ("users",),
    _CTES,
)
def signup_users(spark, d):
    """The users after a batch of sign-ups, with every default."""
    return _shown(ops.sign_up(*_parts(spark, d))[0])


@register("signup_rejects", "SELECT user_id, email_norm, reason FROM decided WHERE reason IS NOT NULL", ("users",), _CTES)
def signup_rejects(spark, d):
    return ops.sign_up(*_parts(spark, d))[1]


# profiles of the batch's users: names missing in turn, some emails of users there, some shared
_PROFILES = f"""SELECT CAST(user_id AS bigint) AS profile_id, CASE WHEN user_id % 3 = 0 THEN name WHEN user_id % 3 = 1 THEN '' END AS display_name,
  CASE WHEN user_id % 2 = 0 THEN concat('Given', CAST(user_id AS string)) END AS given_name,
  CASE WHEN user_id % 11 = 0 THEN ' ' WHEN user_id % 7 < 2 THEN concat(' USER', CAST(user_id - user_id % 10 AS string), '@example.com ') ELSE email END AS email
  FROM {{b}} WHERE NOT ({SPLIT.replace('varchar', 'string')})"""
_TP_CTES = {
    "ex": _CTES["ex"],
    "pr": f"SELECT *, nullif({_EMAIL}, '') AS e FROM ({_PROFILES.format(b='users').replace('AS string', 'AS varchar')}) x",
    "held": f"SELECT {_EMAIL} AS e, min(user_id) AS holder FROM ex WHERE email IS NOT NULL GROUP BY 1",
    "own": "SELECT p.e, min(p.profile_id) AS first_id, min(h.holder) AS holder FROM pr p LEFT JOIN held h ON p.e = h.e WHERE p.e IS NOT NULL GROUP BY p.e",
}


def _profiles(spark, d):
    return spark.sql(_PROFILES, b=U(spark, d))


@register(
    "third_party_users",
    f"""{_OLD_ROWS.format(rows='ex')} UNION ALL
        SELECT p.profile_id, {_S("coalesce(nullif(display_name, ''), nullif(given_name, ''), 'Google User')")}, p.e, NULL, NULL, 'fresher', {_NEW_TAIL}
        FROM pr p JOIN own o ON p.e = o.e WHERE o.holder IS NULL AND p.profile_id = o.first_id""",
    ("users",),
    _TP_CTES,
)
def third_party_users(spark, d):
    return _shown(ops.third_party_sign_in(_parts(spark, d)[0], _profiles(spark, d))[0])


@register(
    "third_party_outcomes",
    """SELECT p.profile_id, CASE WHEN p.e IS NULL THEN 'no_email' WHEN o.holder IS NULL AND p.profile_id = o.first_id THEN 'created' ELSE 'signed_in' END AS status,
         CAST(CASE WHEN p.e IS NOT NULL THEN coalesce(o.holder, o.first_id) END AS bigint) AS user_id FROM pr p LEFT JOIN own o ON p.e = o.e""",
    ("users",),
    _TP_CTES,
)
def third_party_outcomes(spark, d):
    """Who each profile signed in as."""
    return ops.third_party_sign_in(_parts(spark, d)[0], _profiles(spark, d))[1]


_TEXTS = {
    "location": "CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 'Pune' END",
    "bio": "CASE WHEN user_id % 3 = 0 THEN 'about' ELSE '' END",
}
_SIZES = {
    "education": "user_id % 3", "projects": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 2 END",
    "internships": "user_id % 7 % 2", "certifications": "user_id % 11 % 3",
}
_F12 = " + ".join(
    [f"CAST((coalesce({c}, '') <> '') AS int)" for c in ("name", "email", "mobile", "work_status", "college", *(f"({x})" for x in _TEXTS.values()))]
    + [f"CAST((coalesce({x}, 0) > 0) AS int)" for x in _SIZES.values()]
    + [f"CAST(len({_TAGS}) > 0 AS int)"]
)


@register("profile_completion_12_all", f"SELECT user_id, CAST((50 * ({_F12}) + 3) // 6 AS int) AS profile_completion_12 FROM users", ("users",))
def profile_completion_12_all(spark, d):
    """The score over users who have all twelve fields, some null or blank."""
    u = U(spark, d).withColumns({c: F.expr(x) for c, x in _TEXTS.items()})
    return ops.completion_12(u.withColumns({c: F.expr(f"array_repeat(named_struct('title', 'x'), CAST({x} AS int))") for c, x in _SIZES.items()}))
