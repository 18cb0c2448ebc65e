"""User operators: validation, sign-up batches, completion scores, patches,
array replacement, embedded saved arrays, deletion (SURVEY §2.3-§2.8).

Users are keyed by ``user_id``; every per-user step is a projection or a
1:1 equi-join on that key.  Email uniqueness is an aggregate over the
normalised email (partial on the map side) joined back on that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.functions.text import strip_ws, tag_list

# Sign-up rules and defaults.
EMAIL_RE = r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+\z"
MOBILE_RE = r"^[6-9]\d{9}\z"
WORK_STATUSES = ("fresher", "experienced")
DEFAULTS = {
    "work_status": "fresher",
    "experience_level": "Fresher",
    "college": "",
    "degree": "",
    "grad_year": "",
    "resume_link": "",
    "location": "",
    "gender": "",
    "dob": "",
    "bio": "",
    "preferred_job_type": "",
    "availability": "",
}
EMPTY_LISTS = ("preferred_locations", "skills", "education", "projects", "internships", "certifications", "saved_jobs")
THIRD_PARTY_NAME = "Google User"
RULES = ("name", "email", "password", "mobile", "work_status")


def email_norm(c="email") -> Column:
    """Stored form: trimmed, lower-case."""
    return F.lower(strip_ws(F.col(c) if isinstance(c, str) else c))


def _blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def failed_rules(users: DataFrame) -> Column:
    """Array of the sign-up rules a row fails (empty when valid)."""
    name = strip_ws(F.col("name"))
    email = strip_ws(F.col("email"))
    mobile = strip_ws(F.col("mobile"))
    checks = [
        ("name", F.col("name").isNull() | (F.length(name) < 2)),
        ("email", F.col("email").isNull() | ~email.rlike(EMAIL_RE)),
        ("password", F.coalesce(F.col("password_length") < 6, F.lit(True))),
        ("mobile", F.col("mobile").isNull() | ~mobile.rlike(MOBILE_RE)),
        ("work_status", ~F.coalesce(F.col("work_status").isin(*WORK_STATUSES), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in checks]))


def validate(users: DataFrame) -> DataFrame:
    """One row per user: failed rules (comma text) and a valid flag."""
    f = failed_rules(users)
    return users.select(
        "user_id", F.array_join(f, ",").alias("failed"), (F.size(f) == 0).alias("valid")
    )


def validation_counts(users: DataFrame) -> DataFrame:
    """Failures per rule over the table (data-quality report)."""
    return (
        users.select(F.explode(failed_rules(users)).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_failed"))
    )


def email_conflicts(users: DataFrame) -> DataFrame:
    """Users whose stored email another user also has."""
    u = users.filter(F.col("email").isNotNull()).select("user_id", email_norm().alias("email_norm"))
    shared = u.groupBy("email_norm").agg(F.count(F.lit(1)).alias("n_users")).filter(F.col("n_users") > 1)
    return u.join(shared, "email_norm").select("user_id", "email_norm", "n_users")


def signup_batch(users: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply a batch of sign-ups: reject invalid rows, then rows whose email
    an existing user or an earlier valid batch row (by ``user_id``) holds;
    the rest are created with defaults and a timestamp.  Output: every batch
    row with ``status`` (``created`` / ``rejected``) and ``reason``."""
    now = now if now is not None else F.current_timestamp()
    b = _decided(users, batch)
    reason = F.col("_reason")
    return b.select(
        "user_id",
        "email_norm",
        strip_ws(F.col("name")).alias("name"),
        strip_ws(F.col("mobile")).alias("mobile"),
        F.coalesce(F.nullif("work_status", F.lit("")), F.lit(DEFAULTS["work_status"])).alias("work_status"),
        F.lit(DEFAULTS["experience_level"]).alias("experience_level"),
        F.when(reason.isNull(), "created").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), now).alias("created_at"),
    )


def _decided(users: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with ``email_norm`` and ``_reason``, null for those to create."""
    b = batch.withColumn("_failed", failed_rules(batch)).withColumn("email_norm", email_norm())
    existing = users.filter(F.col("email").isNotNull()).select(email_norm().alias("email_norm")).distinct()
    existing = existing.withColumn("_taken", F.lit(True))
    valid = b.filter(F.size("_failed") == 0)
    first = valid.groupBy("email_norm").agg(F.min("user_id").alias("_first_id"))
    # rows that fail a rule are settled: they (and their null emails) do not join
    failed = b.filter(F.size("_failed") > 0)
    b = valid.join(existing, "email_norm", "left").join(first, "email_norm", "left").unionByName(failed, allowMissingColumns=True)
    reason = (
        F.when(F.size("_failed") > 0, F.concat(F.lit("invalid:"), F.array_join("_failed", ",")))
        .when(F.coalesce("_taken", F.lit(False)), F.lit("email_exists"))
        .when(F.col("user_id") != F.col("_first_id"), F.lit("email_exists"))
    )
    return b.withColumn("_reason", reason).drop("_failed", "_taken", "_first_id")


def _new_users(rows: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Rows (user_id, email_norm, name, …) as new users: what a row gives, else
    the default; lists take the type of the users' column."""
    types = {f.name: f.dataType for f in users.schema.fields}
    given = {c: F.coalesce(F.nullif(c, F.lit("")), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in DEFAULTS.items()}
    lists = {c: F.array().cast(types.get(c, "array<string>")) for c in EMPTY_LISTS}
    kept = [F.col(c) for c in rows.columns if c not in {*given, *lists, "user_id", "name", "email", "email_norm", "mobile", "_reason"}]
    return rows.select(
        "user_id",
        strip_ws(F.col("name")).alias("name"),
        F.col("email_norm").alias("email"),
        (strip_ws(F.col("mobile")) if "mobile" in rows.columns else F.lit(None).cast("string")).alias("mobile"),
        *kept,
        *[v.alias(c) for c, v in {**given, **lists}.items()],
        F.lit(True).alias("email_notifications"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


SIGN_UP_FIELDS = ("name", "email", "mobile", "password_length", "work_status")


def sign_up(users: DataFrame, batch: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(users after, rejects (user_id, email_norm, reason)) of a batch of
    sign-ups, decided as by ``signup_batch``.  A sign-up gives its five fields
    only; every other field of a new user has its default.  Columns that the
    users lack are null for those who were there."""
    now = now if now is not None else F.current_timestamp()
    b = _decided(users, batch.select("user_id", *SIGN_UP_FIELDS))
    new = _new_users(b.filter(F.col("_reason").isNull()), users, now)
    rejects = b.filter(F.col("_reason").isNotNull()).select("user_id", "email_norm", F.col("_reason").alias("reason"))
    return users.unionByName(new, allowMissingColumns=True), rejects


def third_party_sign_in(users: DataFrame, profiles: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(users after, outcomes (profile_id, status, user_id)) of sign-ins with
    another party's profile (``profile_id``, ``display_name``, ``given_name``,
    ``email``): who has the email is signed in (of several users the least id);
    else the first profile of an email (least id) becomes a user under its
    ``profile_id`` and later ones sign in to it.  Without an email: ``no_email``."""
    now = now if now is not None else F.current_timestamp()
    p = profiles.withColumn("email_norm", email_norm())
    p = p.withColumn("email_norm", F.nullif("email_norm", F.lit("")))
    asked = p.filter(F.col("email_norm").isNotNull())
    first = asked.groupBy("email_norm").agg(F.min("profile_id").alias("_first"))
    held = users.filter(F.col("email").isNotNull()).groupBy(email_norm().alias("email_norm")).agg(F.min("user_id").alias("_holder"))
    owner = first.join(held, "email_norm", "left")
    j = asked.join(owner, "email_norm")
    creates = F.col("_holder").isNull() & (F.col("profile_id") == F.col("_first"))
    said = j.select(
        "profile_id", F.when(creates, "created").otherwise("signed_in").alias("status"), F.coalesce("_holder", "_first").alias("user_id")
    )
    none = p.filter(F.col("email_norm").isNull()).select("profile_id", F.lit("no_email").alias("status"), F.lit(None).cast("long").alias("user_id"))
    blank = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(blank("display_name"), blank("given_name"), F.lit(THIRD_PARTY_NAME))
    new = _new_users(j.filter(creates).select(F.col("profile_id").alias("user_id"), name.alias("name"), "email_norm"), users, now)
    return users.unionByName(new, allowMissingColumns=True), said.unionByName(none)


def skills(users: DataFrame) -> Column:
    return F.col("skills") if "skills" in users.columns else tag_list("skills_csv")


def completion_score(users: DataFrame) -> Column:
    """20 points each: name, email, (degree and college and grad year),
    at least one skill, resume link; blanks do not count."""
    def filled(c):
        return ~_blank(F.col(c)) if c in users.columns else F.lit(False)

    pts = [
        filled("name"),
        filled("email"),
        filled("degree") & filled("college") & filled("grad_year"),
        F.size(skills(users)) > 0,
        filled("resume_link"),
    ]
    return reduce(lambda a, b: a + b, [F.when(p, 20).otherwise(0) for p in pts]).cast("int")


def profile_completion(users: DataFrame) -> DataFrame:
    return users.select("user_id", completion_score(users).alias("profile_completion"))


def completion_histogram(users: DataFrame) -> DataFrame:
    return profile_completion(users).groupBy("profile_completion").agg(F.count(F.lit(1)).alias("n_users"))


def completion_12(users: DataFrame) -> DataFrame:
    """Client-side score: ``round(100 × filled / 12)`` over seven text fields
    and five lists; whitespace counts as filled."""
    def present(c):
        return (F.col(c).isNotNull() & (F.col(c) != "")) if c in users.columns else F.lit(False)

    def nonempty_list(c):
        if c == "skills":
            return F.size(skills(users)) > 0
        return F.coalesce(F.size(F.col(c)) > 0, F.lit(False)) if c in users.columns else F.lit(False)

    flags = [present(c) for c in ("name", "email", "mobile", "work_status", "college", "location", "bio")]
    flags += [nonempty_list(c) for c in ("skills", "education", "projects", "internships", "certifications")]
    n = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
    # Math.round(100 n / 12) = floor((50 n + 3) / 6) in integers
    return users.select("user_id", ((n * 50 + 3) / 6).cast("int").alias("profile_completion_12"))


def profile_view(users: DataFrame) -> DataFrame:
    """The user row without the password field, plus the completion score."""
    keep = [c for c in users.columns if c not in ("password", "password_hash", "password_length")]
    return users.select(*keep, completion_score(users).alias("profile_completion"))


def user_summary(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id", "name", "email", "mobile", "work_status", completion_score(users).alias("profile_completion")
    )


def _arrival(df: DataFrame, order: list[str] | None) -> Column:
    """Order of a batch's rows: the named columns, else as they came."""
    return F.struct(*order) if order else F.struct(F.monotonically_increasing_id().alias("n"))


def patch_users(users: DataFrame, patches: DataFrame, fields: list[str], order: list[str] | None = None) -> DataFrame:
    """Overlay the fields present in each user's patch map: a present key
    sets its value (even null or ''), an absent key keeps the field.  Several
    patches of a user apply in ``order``: the last that has a key sets it."""
    each = patches.select("user_id", _arrival(patches, order).alias("_o"), F.explode("patch").alias("k", "v"))
    last = each.groupBy("user_id", "k").agg(F.max_by(F.struct("v"), "_o").alias("_v"))
    p = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "_v.v"))).alias("_p"))
    j = users.join(p, "user_id", "left")
    cols = [
        F.when(F.coalesce(F.map_contains_key("_p", F.lit(c)), F.lit(False)), F.col("_p")[c]).otherwise(F.col(c)).alias(c)
        if c in fields
        else F.col(c)
        for c in users.columns
    ]
    return j.select(*cols)


def replace_array(users: DataFrame, field: str, values: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Replace one array field for the users in ``values(user_id, <field>)``;
    of several values for a user the last in ``order`` stays."""
    v = values.select("user_id", F.struct(F.col(field).alias("x")).alias("_x"), _arrival(values, order).alias("_o"))
    v = v.groupBy("user_id").agg(F.max_by("_x", "_o").alias("_x")).select("user_id", F.col("_x.x").alias("_new"))
    j = users.join(v, "user_id", "left")
    return j.select(*[F.coalesce("_new", F.col(c)).alias(c) if c == field else F.col(c) for c in users.columns])


# ---- embedded saved arrays ---------------------------------------------------------

ELEMENT = "struct<str:string,job_id:string,id:string,oid:string>"


def element_id(e: Column) -> Column:
    return F.coalesce(e["str"], e["job_id"], e["id"], e["oid"])


def embedded_save(arrays: DataFrame, requests: DataFrame) -> DataFrame:
    """Append ``{jobId}`` for each requested id unless an element already has
    it as string, ``jobId`` or ``id``; requests apply in (ts, request_id)
    order, so a repeated id is appended once."""
    firsts = requests.groupBy("user_id", "job_id").agg(F.min(F.struct("ts", "request_id")).alias("_o"))
    new = firsts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_o", "job_id"))).alias("_new"))
    j = arrays.join(new, "user_id", "left").select(  # requests of unknown users change nothing
        "user_id", F.coalesce("saved", F.array().cast(f"array<{ELEMENT}>")).alias("saved"), "_new"
    )

    def known(arr, x):
        return F.exists(
            arr, lambda e: F.coalesce((e["str"] == x) | (e["job_id"] == x) | (e["id"] == x), F.lit(False))
        )

    add = F.transform(
        F.filter("_new", lambda n: ~known(F.col("saved"), n["job_id"])),
        lambda n: F.struct(
            F.lit(None).cast("string").alias("str"), n["job_id"].alias("job_id"),
            F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("oid"),
        ),
    )
    add = F.coalesce(add, F.array().cast(f"array<{ELEMENT}>"))
    return j.select("user_id", F.concat("saved", add).alias("saved"))


def embedded_unsave(arrays: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove elements whose string value, ``jobId``, ``id`` or ``_id`` equals
    a requested id; ``n_removed = 0`` is the not-found case."""
    ids = requests.groupBy("user_id").agg(F.collect_set("job_id").alias("_ids"))
    j = arrays.join(ids, "user_id", "left")
    hit = lambda e: F.coalesce(
        F.array_contains(F.col("_ids"), e["str"]) | F.array_contains(F.col("_ids"), e["job_id"])
        | F.array_contains(F.col("_ids"), e["id"]) | F.array_contains(F.col("_ids"), e["oid"]),
        F.lit(False),
    )
    kept = F.when(F.col("_ids").isNull(), F.col("saved")).otherwise(F.filter("saved", lambda e: ~hit(e)))
    return j.select("user_id", kept.alias("saved"), (F.size("saved") - F.size(kept)).alias("n_removed"))


def delete_users(users: DataFrame, ids: DataFrame, saved: DataFrame | None = None, cascade: bool = False):
    """Remove accounts.  Saved mappings stay behind (D10) unless ``cascade``,
    which returns ``(users', saved')``."""
    left = users.join(ids.select("user_id"), "user_id", "left_anti")
    if cascade:
        if saved is None:
            raise ValueError("cascade needs the saved table")
        return left, saved.join(ids.select("user_id"), "user_id", "left_anti")
    return left
