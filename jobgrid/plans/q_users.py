"""User queries: scans, validation, sign-up, completion, patches, arrays,
embedded saved arrays, deletion."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.functions.text import skill_add, skill_remove, tag_list
from jobgrid.operators import users as ops
from jobgrid.plans.catalog import register, sql_strip
from jobgrid.sources import fixtures as fx

U, S, R = fx.users, fx.saved_jobs, fx.requests

USER_COLS = (
    "user_id, name, email, mobile, password_length, work_status, degree, college, grad_year, "
    "skills_csv, resume_link, preferred_job_type"
)
SPLIT = "substr(md5(CAST(user_id AS varchar)), 1, 1) < '8'"  # existing users / sign-up batch
ADD_SKILL, REMOVE_SKILL = "Spark", "sql"

_S = sql_strip
_EMAIL_RX = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_FAILED = f"""concat_ws(',',
    CASE WHEN name IS NULL OR length({_S('name')}) < 2 THEN 'name' END,
    CASE WHEN email IS NULL OR NOT regexp_matches({_S('email')}, '{_EMAIL_RX}') THEN 'email' END,
    CASE WHEN coalesce(password_length < 6, TRUE) THEN 'password' END,
    CASE WHEN mobile IS NULL OR NOT regexp_matches({_S('mobile')}, '^[6-9][0-9]{{9}}$') THEN 'mobile' END,
    CASE WHEN work_status IS NULL OR work_status NOT IN ('fresher', 'experienced') THEN 'work_status' END)"""
_TAGS = f"list_filter(list_transform(string_split(coalesce(skills_csv, ''), ','), lambda x: {_S('x')}), lambda x: x <> '')"


def _filled(c: str) -> str:
    return f"({c} IS NOT NULL AND {_S(c)} <> '')"


_SCORE = f"""(CASE WHEN {_filled('name')} THEN 20 ELSE 0 END + CASE WHEN {_filled('email')} THEN 20 ELSE 0 END
   + CASE WHEN {_filled('degree')} AND {_filled('college')} AND {_filled('grad_year')} THEN 20 ELSE 0 END
   + CASE WHEN len({{tags}}) > 0 THEN 20 ELSE 0 END + CASE WHEN {_filled('resume_link')} THEN 20 ELSE 0 END)"""
SCORE = _SCORE.format(tags=_TAGS)


@register("scan_users", f"SELECT {USER_COLS} FROM users", ("users",))
def scan_users(spark, d):
    return U(spark, d)


@register("scan_saved", "SELECT user_id, job_id, saved_at FROM saved_jobs", ("saved_jobs",))
def scan_saved(spark, d):
    return S(spark, d)


@register(
    "validate_signup",
    f"SELECT user_id, failed, failed = '' AS valid FROM (SELECT user_id, {_FAILED} AS failed FROM users) v",
    ("users",),
)
def validate_signup(spark, d):
    return ops.validate(U(spark, d))


@register(
    "validate_signup_counts",
    f"""SELECT rule, count(*) AS n_failed FROM (
          SELECT unnest(string_split(f, ',')) AS rule FROM (SELECT {_FAILED} AS f FROM users) v WHERE f <> '') x
        GROUP BY rule""",
    ("users",),
)
def validate_signup_counts(spark, d):
    return ops.validation_counts(U(spark, d))


@register(
    "email_conflicts",
    f"""WITH e AS (SELECT user_id, lower({_S('email')}) AS email_norm FROM users WHERE email IS NOT NULL)
        SELECT e.user_id, e.email_norm, c.n_users FROM e JOIN (
          SELECT email_norm, count(*) AS n_users FROM e GROUP BY email_norm HAVING count(*) > 1) c USING (email_norm)""",
    ("users",),
)
def email_conflicts(spark, d):
    return ops.email_conflicts(U(spark, d))


@register(
    "signup_batch",
    f"""WITH ex AS (SELECT * FROM users WHERE {SPLIT}),
      bt AS (SELECT *, lower({_S('email')}) AS email_norm, {_FAILED} AS failed FROM users WHERE NOT ({SPLIT})),
      taken AS (SELECT DISTINCT lower({_S('email')}) AS email_norm FROM ex WHERE email IS NOT NULL),
      fst AS (SELECT email_norm, min(user_id) AS fid FROM bt WHERE failed = '' GROUP BY email_norm),
      r AS (SELECT bt.*, CASE WHEN failed <> '' THEN 'invalid:' || failed
                              WHEN t.email_norm IS NOT NULL THEN 'email_exists'
                              WHEN bt.user_id <> fst.fid THEN 'email_exists' END AS reason
            FROM bt LEFT JOIN taken t ON bt.email_norm = t.email_norm LEFT JOIN fst ON bt.email_norm = fst.email_norm)
    SELECT user_id, email_norm, {_S('name')} AS name, {_S('mobile')} AS mobile,
           coalesce(nullif(work_status, ''), 'fresher') AS work_status, 'Fresher' AS experience_level,
           CASE WHEN reason IS NULL THEN 'created' ELSE 'rejected' END AS status, reason FROM r""",
    ("users",),
)
def signup_batch(spark, d):
    u = U(spark, d)
    split = F.substring(F.md5(F.col("user_id").cast("string")), 1, 1) < "8"
    return ops.signup_batch(u.filter(split), u.filter(~split)).drop("created_at")


@register("profile_completion", f"SELECT user_id, CAST({SCORE} AS int) AS profile_completion FROM users", ("users",))
def profile_completion(spark, d):
    return ops.profile_completion(U(spark, d))


@register(
    "profile_completion_hist",
    f"SELECT CAST({SCORE} AS int) AS profile_completion, count(*) AS n_users FROM users GROUP BY 1",
    ("users",),
)
def profile_completion_hist(spark, d):
    return ops.completion_histogram(U(spark, d))


_F12 = " + ".join(
    [f"CAST((coalesce({c}, '') <> '') AS int)" for c in ("name", "email", "mobile", "work_status", "college")]
    + [f"CAST(len({_TAGS}) > 0 AS int)"]
)


@register(
    "profile_completion_12",
    f"SELECT user_id, CAST((50 * ({_F12}) + 3) // 6 AS int) AS profile_completion_12 FROM users",
    ("users",),
)
def profile_completion_12(spark, d):
    return ops.completion_12(U(spark, d))


@register(
    "profile_view",
    f"""SELECT user_id, name, email, mobile, work_status, degree, college, grad_year, skills_csv, resume_link,
          preferred_job_type, CAST({SCORE} AS int) AS profile_completion FROM users""",
    ("users",),
)
def profile_view(spark, d):
    return ops.profile_view(U(spark, d))


@register(
    "user_summary",
    f"SELECT user_id, name, email, mobile, work_status, CAST({SCORE} AS int) AS profile_completion FROM users",
    ("users",),
)
def user_summary(spark, d):
    return ops.user_summary(U(spark, d))


def _with_profile(u):
    return u.withColumn("location", F.lit("")).withColumn("bio", F.lit(""))


def _patches(u):
    uid = F.col("user_id")
    entries = F.array(
        F.when(uid % 2 == 0, F.struct(F.lit("location").alias("k"), F.concat(F.lit("City "), (uid % 10).cast("string")).alias("v"))),
        F.when(uid % 5 == 0, F.struct(F.lit("bio").alias("k"), F.lit("").alias("v"))),
        F.when(uid % 3 == 0, F.struct(F.lit("name").alias("k"), F.upper(F.trim("name")).alias("v"))),
    )
    return u.select("user_id", F.map_from_entries(F.array_compact(entries)).alias("patch"))


@register(
    "profile_patch",
    """SELECT user_id,
         CASE WHEN user_id % 3 = 0 THEN upper(trim(name)) ELSE name END AS name,
         CASE WHEN user_id % 2 = 0 THEN 'City ' || CAST(user_id % 10 AS varchar) ELSE '' END AS location,
         '' AS bio, college FROM users""",
    ("users",),
)
def profile_patch(spark, d):
    u = U(spark, d)
    out = ops.patch_users(_with_profile(u), _patches(u), ["name", "location", "bio", "college"])
    return out.select("user_id", "name", "location", "bio", "college")


_NEW_SKILLS = (
    f"list_filter(CASE WHEN list_contains({_TAGS}, '{ADD_SKILL}') THEN {_TAGS} ELSE list_append({_TAGS}, '{ADD_SKILL}') END, "
    f"lambda x: x <> '{REMOVE_SKILL}')"
)


@register(
    "replace_array_field",
    f"""SELECT user_id, array_to_string(sk, '|') AS skills, CAST({_SCORE.format(tags='sk')} AS int) AS profile_completion
        FROM (SELECT *, CASE WHEN name IS NOT NULL THEN {_NEW_SKILLS} ELSE {_TAGS} END AS sk FROM users) x""",
    ("users",),
)
def replace_array_field(spark, d):
    u = U(spark, d).withColumn("skills", tag_list("skills_csv")).drop("skills_csv")
    values = u.filter(F.col("name").isNotNull()).select(
        "user_id", skill_remove(skill_add("skills", ADD_SKILL), REMOVE_SKILL).alias("skills")
    )
    out = ops.replace_array(u, "skills", values)
    return out.select(
        "user_id", F.array_join("skills", "|").alias("skills"), ops.completion_score(out).alias("profile_completion")
    )


# ---- embedded saved arrays -----------------------------------------------------------


def initial_arrays(spark, d):
    """Each user's embedded saved array, nested from the saved mappings:
    elements are a bare id, ``{jobId}`` or ``{id}`` by the id's last digit."""
    s = S(spark, d)
    last = F.substring("job_id", 24, 1)
    elem = F.struct(
        F.when(last.isin(*"01234"), F.col("job_id")).alias("str"),
        F.when(last.isin(*"56789"), F.col("job_id")).alias("job_id"),
        F.when(last.isin(*"abcdef"), F.col("job_id")).alias("id"),
        F.lit(None).cast("string").alias("oid"),
    )
    nested = s.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("saved_at", "job_id", elem.alias("e")))).alias("_l"))
    arrays = nested.select("user_id", F.transform("_l", lambda x: x["e"]).alias("saved"))
    users = U(spark, d).select("user_id")
    return users.join(arrays, "user_id", "left").select(
        "user_id", F.coalesce("saved", F.array().cast(f"array<{ops.ELEMENT}>")).alias("saved")
    )


def _emb_out(df, extra=()):
    ids = F.array_join(F.transform("saved", ops.element_id), ",")
    return df.select("user_id", F.size("saved").alias("n_saved"), ids.alias("ids"), *extra)


_INIT = {
    "init": "SELECT user_id, job_id, saved_at FROM saved_jobs",
}


@register(
    "embedded_save",
    """WITH sr AS (SELECT user_id, job_id, min(ts) AS o_ts, arg_min(request_id, (ts, request_id)) AS o_rid FROM requests WHERE action = 'save' GROUP BY user_id, job_id),
      nw AS (SELECT * FROM sr WHERE NOT EXISTS (SELECT 1 FROM init i WHERE i.user_id = sr.user_id AND i.job_id = sr.job_id)),
      el AS (SELECT user_id, job_id, 0 AS part, saved_at AS t, job_id AS ks, CAST(0 AS bigint) AS kn FROM init
             UNION ALL SELECT user_id, job_id, 1, o_ts, '', o_rid FROM nw)
    SELECT u.user_id, CAST(count(el.job_id) AS int) AS n_saved,
           coalesce(string_agg(el.job_id, ',' ORDER BY el.part, el.t, el.ks, el.kn), '') AS ids
    FROM users u LEFT JOIN el ON u.user_id = el.user_id GROUP BY u.user_id""",
    ("users", "saved_jobs", "requests"),
    _INIT,
)
def embedded_save(spark, d):
    reqs = R(spark, d).filter(F.col("action") == "save")
    out = ops.embedded_save(initial_arrays(spark, d), reqs)
    return _emb_out(out).join(U(spark, d).select("user_id"), "user_id", "left_semi")


@register(
    "embedded_unsave",
    """WITH el AS (SELECT * FROM init i WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.action = 'unsave'
                   AND r.user_id = i.user_id AND r.job_id = i.job_id)),
      rm AS (SELECT user_id, count(*) AS n FROM init i WHERE EXISTS (SELECT 1 FROM requests r WHERE r.action = 'unsave'
                   AND r.user_id = i.user_id AND r.job_id = i.job_id) GROUP BY user_id)
    SELECT u.user_id, CAST(count(el.job_id) AS int) AS n_saved, coalesce(string_agg(el.job_id, ',' ORDER BY el.saved_at, el.job_id), '') AS ids,
           CAST(coalesce(max(rm.n), 0) AS int) AS n_removed
    FROM users u LEFT JOIN el ON u.user_id = el.user_id LEFT JOIN rm ON u.user_id = rm.user_id GROUP BY u.user_id""",
    ("users", "saved_jobs", "requests"),
    _INIT,
)
def embedded_unsave(spark, d):
    reqs = R(spark, d).filter(F.col("action") == "unsave")
    out = ops.embedded_unsave(initial_arrays(spark, d), reqs)
    return _emb_out(out, ("n_removed",))


@register(
    "delete_users",
    f"SELECT user_id, name, email FROM users WHERE email IS NOT NULL AND regexp_matches({_S('email')}, '{_EMAIL_RX}')",
    ("users",),
)
def delete_users(spark, d):
    u = U(spark, d)
    bad = ops.validate(u).filter(F.col("failed").contains("email")).select("user_id")
    return ops.delete_users(u, bad).select("user_id", "name", "email")


@register(
    "delete_users_cascade",
    f"""SELECT user_id, job_id, saved_at FROM saved_jobs s WHERE user_id NOT IN (
          SELECT user_id FROM users WHERE NOT (email IS NOT NULL AND regexp_matches({_S('email')}, '{_EMAIL_RX}')))""",
    ("users", "saved_jobs"),
)
def delete_users_cascade(spark, d):
    """The saved mappings that stay when the accounts go with theirs."""
    u = U(spark, d)
    bad = ops.validate(u).filter(F.col("failed").contains("email")).select("user_id")
    return ops.delete_users(u, bad, S(spark, d), cascade=True)[1].select("user_id", "job_id", "saved_at")
