"""Landed pages → records → one listing schema.

JSON bodies are parsed once into ``VARIANT`` (``try_parse_json``: a malformed
body is a failed page, not a failed job); the record array is read with
``try_variant_get(.., 'array<variant>')`` and exploded with its position.
Fields that are a string in one response and an object in another are told
apart with ``schema_of_variant``.  HTML bodies go through the one
``mapInPandas`` extractor.  Every normaliser returns ``(listings, rejects)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrid.functions.text import (
    NA,
    NOT_DISCLOSED,
    absolute_url,
    iso_date,
    join_nonempty,
    nonempty,
    salary_text,
    snippet,
    strip_chars,
    valid_object_id,
)
from jobgrid.sources import html as H
from jobgrid.sources.landing import LOCAL_ZONE, page_policy, policy_of

# Fixed values of the sources (hosts, defaults, selectors).
INTERNSHALA_HOST = "https://internshala.com"
UNSTOP_HOST = "https://unstop.com"
INTERN_DETAIL = "/internship/detail/"
INTERNSHALA_CARD = ".individual_internship"
INTERNSHALA_FIELDS = {
    "title": H.Field((".job-internship-name", ".profile")),
    "company": H.Field((".company-name", ".company_name")),
    "location": H.Field((".location_names", "#location_names")),
    "stipend": H.Field((".stipend",)),
    "bodies": H.Field((".item_body",), "texts"),
    "href": H.Field(("a[href]",), "attr", "href", INTERN_DETAIL),
    "ref": H.Field(('meta[itemprop]',), "attr", "content"),
}
LINKEDIN_CARD = "li.result-card"
LINKEDIN_FIELDS = {
    "title": H.Field(("h3.result-card__title",)),
    "company": H.Field(("h4.result-card__subtitle",)),
    "location": H.Field(("span.job-result-card__location",)),
    "href": H.Field(("a.result-card__full-card-link",), "attr", "href"),
    "ref": H.Field(('meta[itemprop]',), "attr", "content"),
}

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("stipend", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("job_url", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("date_posted", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("job_description_snippet", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("scraped_at", T.TimestampNTZType()),
    ]
)
LISTING_COLUMNS = LISTING_SCHEMA.fieldNames()
PAGE_KEYS = ["run_id", "source", "page"]


# ---- variant helpers ---------------------------------------------------------------


def vget(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def str_or_field(v: Column, key: str) -> Column:
    """``x.get(key) if isinstance(x, dict) else x`` as a string."""
    return F.when(is_object(v), vget(v, f"$.{key}")).otherwise(vget(v, "$"))


def number_text(v: Column) -> Column:
    """A JSON value as Python prints it: an integer plainly, a number with a
    fraction or exponent as a float (``50000.0``, ``10000000.0``, ``1.5e+20``),
    text as it is."""
    d = vget(v, "$", "double")
    whole = F.concat(F.format_string("%.0f", d), F.lit(".0"))
    broken = F.regexp_replace(d.cast("string").cast("decimal(38,14)").cast("string"), "0+$", "")
    wide = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1")
    as_float = F.when(F.abs(d) >= 1e16, wide).when(d == F.floor(d), whole).otherwise(broken)
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), as_float).otherwise(vget(v, "$"))


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value (null, '', {}, [], 0, false are falsy)."""
    j = F.to_json(v)
    return F.coalesce(
        v.isNotNull() & ~F.is_variant_null(v) & ~j.isin('""', "{}", "[]", "0", "0.0", "false"), F.lit(False)
    )


# ---- pages → records ----------------------------------------------------------------


def _records_path(v: Column, source: str) -> Column:
    empty = F.array().cast("array<variant>")
    if source == "Naukri":
        return F.coalesce(vget(v, "$.results", "array<variant>"), empty)
    if source == "Indeed":
        return F.coalesce(vget(v, "$.data.jobs", "array<variant>"), empty)
    if source == "Unstop":
        data = vget(v, "$.data", "variant")
        inner = (
            F.when(is_object(data), vget(v, "$.data.data", "array<variant>"))
            .when(F.schema_of_variant(data).startswith("ARRAY"), vget(v, "$.data", "array<variant>"))
        )
        inner = F.coalesce(inner, empty)
        fallback = F.coalesce(vget(v, "$.records", "array<variant>"), empty)
        return F.when(F.size(inner) > 0, inner).otherwise(fallback)
    raise ValueError(f"no JSON record path for {source}")


def json_pages(landing: DataFrame, source: str) -> DataFrame:
    """Pages of one JSON source with their record array and page flags."""
    v = F.try_parse_json("body")
    p = landing.filter(F.col("source") == source).select(*PAGE_KEYS, "status", "fetched_at", v.alias("_v"))
    recs = F.when(F.col("_v").isNotNull(), _records_path(F.col("_v"), source))
    bad = (F.col("status") != 200) | F.col("_v").isNull()
    found = p.select(*PAGE_KEYS, "status", "fetched_at", recs.alias("_recs"), bad.alias("bad"))
    return found.withColumn("empty", F.coalesce(F.size("_recs"), F.lit(0)) == 0)


def json_records(landing: DataFrame, source: str, config: DataFrame) -> DataFrame:
    """``(run_id, source, page, pos, fetched_at, rec variant)`` of the pages the
    source's failure policy keeps.  Each body is parsed once: the outer explode
    keeps a test of the records out of the scan, where it would parse again."""
    if policy_of(source) == "skip":  # a body that is no JSON has no records
        kept = json_pages(landing.filter(F.col("status") == 200), source)
    else:
        kept = page_policy(json_pages(landing, source), config, source)
    recs = kept.select(*PAGE_KEYS, "fetched_at", F.posexplode_outer("_recs").alias("pos", "rec"))
    return recs.filter(F.col("pos").isNotNull())


def html_pages(landing: DataFrame, source: str, container: str, fields: dict) -> DataFrame:
    """Pages of one HTML source with their cards and page flags; a body is
    parsed once, and not at all when the fetch failed."""
    pages = landing.filter(F.col("source") == source).select(*PAGE_KEYS, "status", "fetched_at", "body")
    body = F.when(F.col("status") == 200, F.col("body")).otherwise(F.lit(""))
    found = H.page_cards(pages.withColumn("body", F.coalesce(body, F.lit(""))), container, fields,
                         keys=[*PAGE_KEYS, "status", "fetched_at"])
    bad = F.col("status") != 200
    return found.select(
        *PAGE_KEYS, "status", "fetched_at", "cards", bad.alias("bad"), (~bad & (F.col("n_found") == 0)).alias("empty")
    )


def html_records(landing: DataFrame, source: str, config: DataFrame, container: str, fields: dict) -> DataFrame:
    """Cards of the pages the source's policy keeps."""
    if policy_of(source) == "skip":  # decided by the status alone: no page row is needed
        pages = landing.filter((F.col("source") == source) & (F.col("status") == 200))
        return H.html_cards(pages, container, fields, keys=[*PAGE_KEYS, "fetched_at"])
    kept = page_policy(html_pages(landing, source, container, fields), config, source)
    return kept.select(*PAGE_KEYS, "fetched_at", F.inline("cards"))


def page_flags(landing: DataFrame) -> DataFrame:
    """One row per landed page of every source: ``bad`` and ``empty``."""
    frames = []
    for src in ("Naukri", "Indeed", "Unstop"):
        frames.append(json_pages(landing, src).select(*PAGE_KEYS, "status", "bad", "empty"))
    for src, cont, flds in (("Internshala", INTERNSHALA_CARD, INTERNSHALA_FIELDS), ("LinkedIn", LINKEDIN_CARD, LINKEDIN_FIELDS)):
        frames.append(html_pages(landing, src, cont, {"ref": flds["ref"]}).select(*PAGE_KEYS, "status", "bad", "empty"))
    return unify(*frames)


# ---- scrape time ------------------------------------------------------------------


def scraped_at(fetched_at: Column, local: bool, zone: str = LOCAL_ZONE) -> Column:
    """Naive local time (Internshala, Unstop) or UTC ISO text (the others) →
    one UTC wall-clock ``TIMESTAMP_NTZ`` (D7), independent of the session zone."""
    ts = F.to_timestamp_ntz(F.replace(fetched_at, F.lit("T"), F.lit(" ")))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts) if local else ts


def _finish(df: DataFrame) -> DataFrame:
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(LISTING_SCHEMA[c].dataType).alias(c) for c in LISTING_COLUMNS]
    return df.select(*cols)


def _empty_rejects(df: DataFrame) -> DataFrame:
    return df.select(*PAGE_KEYS, "pos", F.lit(None).cast("string").alias("reason")).limit(0)


# ---- per-source normalisers -----------------------------------------------------------


def norm_naukri(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = F.col("rec")
    out = records.select(
        *PAGE_KEYS, "pos",
        vget(r, "$.id").alias("job_id"),
        vget(r, "$.title").alias("title"),
        str_or_field(vget(r, "$.company", "variant"), "display_name").alias("company"),
        str_or_field(vget(r, "$.location", "variant"), "display_name").alias("location"),
        vget(r, "$.redirect_url").alias("job_url"),
        vget(r, "$.created").alias("date_posted"),
        vget(r, "$.description").alias("description"),
        scraped_at(F.col("fetched_at"), False).alias("scraped_at"),
    ).withColumn("source", F.lit("Naukri"))
    return _finish(out), _empty_rejects(records)


def norm_indeed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = F.col("rec")
    city, state = vget(r, "$.job_city"), vget(r, "$.job_state")
    records = records.withColumns({f"_{x}": vget(r, f"$.job_{x}_salary", "variant") for x in ("min", "max")})
    records = records.withColumn("_parts", join_nonempty([city, state]))
    parts = F.col("_parts")
    country = F.coalesce(vget(r, "$.job_country"), F.lit("India"))
    out = records.select(
        *PAGE_KEYS, "pos",
        vget(r, "$.id").alias("job_id"),
        F.coalesce(vget(r, "$.job_title"), F.lit(NA)).alias("title"),
        F.coalesce(vget(r, "$.employer_name"), F.lit(NA)).alias("company"),
        F.when(parts != "", parts).otherwise(country).alias("location"),
        salary_text(
            number_text(F.col("_min")), number_text(F.col("_max")),
            vget(r, "$.job_salary_period"), vget(r, "$.job_salary_currency"),
        ).alias("stipend"),
        F.lit("Permanent").alias("duration"),
        F.coalesce(vget(r, "$.job_apply_link"), F.lit(NA)).alias("job_url"),
        iso_date(vget(r, "$.job_posted_at_datetime_utc")).alias("date_posted"),
        snippet(vget(r, "$.job_description")).alias("job_description_snippet"),
        scraped_at(F.col("fetched_at"), False).alias("scraped_at"),
    ).withColumn("source", F.lit("Indeed"))
    return _finish(out), _empty_rejects(records)


def norm_unstop(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without a title are dropped; a record whose ``job_type`` is a
    JSON null goes to ``rejects`` (D14)."""
    r = F.col("rec")
    org, raw, jt_v, public = F.col("_org"), F.col("_place"), F.col("_type"), F.col("_public")
    city_v = F.col("_city")
    place = F.when(truthy(city_v), city_v).otherwise(F.coalesce(vget(r, "$.locations[0]", "variant"), city_v))
    joined = F.concat_ws(
        ", ",
        F.coalesce(vget(raw, "$.city"), F.lit("")),
        F.coalesce(vget(raw, "$.state"), F.lit("")),
        F.coalesce(vget(raw, "$.country"), F.lit("")),
    )
    location = F.when(is_object(raw), strip_chars(joined, ", ")).otherwise(nonempty(vget(raw, "$"), "Remote"))
    job_type = F.coalesce(vget(jt_v, "$"), F.lit("Full-time"))
    url = F.when(F.coalesce(public, F.lit("")) != "", F.concat(F.lit(UNSTOP_HOST + "/"), public)).otherwise(
        F.lit(UNSTOP_HOST)
    )
    base = records.select(
        *PAGE_KEYS, "pos", "fetched_at", r,
        vget(r, "$.title").alias("title"),
        vget(r, "$.job_type", "variant").alias("_type"),
        vget(r, "$.organisation", "variant").alias("_org"),
        vget(r, "$.city", "variant").alias("_city"),
        vget(r, "$.public_url").alias("_public"),
    ).withColumns({"_null_type": jt_v.isNotNull() & F.is_variant_null(jt_v), "_place": place})
    titled = base.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    rejects = titled.filter("_null_type").select(*PAGE_KEYS, "pos", F.lit("null job_type").alias("reason"))
    out = titled.filter(~F.col("_null_type")).select(
        *PAGE_KEYS, "pos",
        vget(r, "$.id").alias("job_id"),
        "title",
        F.when(is_object(org), F.coalesce(vget(org, "$.name"), F.lit(NA))).otherwise(F.lit(NA)).alias("company"),
        location.alias("location"),
        nonempty(vget(r, "$.salary"), NOT_DISCLOSED).alias("stipend"),
        F.when(F.contains(F.lower(job_type), F.lit("job")), F.lit("Permanent")).otherwise(F.lit("3 Months")).alias("duration"),
        url.alias("job_url"),
        url.alias("link"),
        scraped_at(F.col("fetched_at"), True).alias("scraped_at"),
    ).withColumn("source", F.lit("Unstop"))
    return _finish(out), rejects


def norm_internshala(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards lacking a title are dropped."""
    b = F.col("bodies")
    url = F.when(F.col("href").isNotNull(), absolute_url("href", INTERNSHALA_HOST)).otherwise(F.lit(""))
    out = cards.filter(F.col("title").isNotNull()).select(
        *PAGE_KEYS, "pos",
        F.col("ref").alias("job_id"),
        "title",
        F.coalesce("company", F.lit(NA)).alias("company"),
        F.coalesce("location", F.lit("Remote")).alias("location"),
        F.coalesce("stipend", F.lit("Unpaid")).alias("stipend"),
        F.when(F.size(b) > 1, b[1]).when(F.size(b) == 1, b[0]).otherwise(F.lit("3 Months")).alias("duration"),
        url.alias("job_url"),
        url.alias("link"),
        scraped_at(F.col("fetched_at"), True).alias("scraped_at"),
    ).withColumn("source", F.lit("Internshala"))
    return _finish(out), _empty_rejects(cards)


def norm_linkedin(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = cards.select(
        *PAGE_KEYS, "pos",
        F.col("ref").alias("job_id"),
        F.coalesce("title", F.lit(NA)).alias("title"),
        F.coalesce("company", F.lit(NA)).alias("company"),
        F.coalesce("location", F.lit(NA)).alias("location"),
        F.coalesce("href", F.lit("")).alias("job_url"),
        scraped_at(F.col("fetched_at"), False).alias("scraped_at"),
    ).withColumn("source", F.lit("LinkedIn"))
    return _finish(out), _empty_rejects(cards)


# ---- one entry point per source ----------------------------------------------------------


def normalize(landing: DataFrame, source: str, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windowed landing pages of ``source`` → (listings, rejects)."""
    if source in ("Naukri", "Indeed", "Unstop"):
        recs = json_records(landing, source, config)
        return {"Naukri": norm_naukri, "Indeed": norm_indeed, "Unstop": norm_unstop}[source](recs)
    if source == "Internshala":
        return norm_internshala(html_records(landing, source, config, INTERNSHALA_CARD, INTERNSHALA_FIELDS))
    if source == "LinkedIn":
        return norm_linkedin(html_records(landing, source, config, LINKEDIN_CARD, LINKEDIN_FIELDS))
    raise ValueError(f"unknown source {source!r}")


def unify(*frames: DataFrame) -> DataFrame:
    """Different record shapes → one collection (missing columns null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assign_job_ids(df: DataFrame) -> DataFrame:
    """Stable 24-hex ids (D10).  A record's own id is kept only if it is an
    object id and the first of its kind in the run; every other record gets
    a hash of (run, source, title, company, job_url), each with its length or
    a null mark, and of the repeat number of that tuple in the run.  So ids of
    two runs or of two equal records differ, a null differs from an empty
    field, and the same pages give the same ids."""
    fields = ("run_id", "source", "title", "company", "job_url")
    rep = F.row_number().over(Window.partitionBy(*fields).orderBy("page", "pos"))
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in fields]
    h = F.substring(F.sha2(F.concat(*marked, F.lit("#"), rep.cast("string")), 256), 1, 24)
    # records without an object id share no window: their row stands for itself
    shown = F.when(valid_object_id("job_id"), F.lower("job_id"))
    df = df.withColumn("_h", h).withColumn("_own", shown)
    nth = F.row_number().over(Window.partitionBy("run_id", F.coalesce("_own", "_h")).orderBy("source", "page", "pos"))
    own = F.when(F.col("_own").isNotNull() & (nth == 1), F.col("job_id"))
    return df.withColumn("job_id", F.coalesce(own, F.col("_h"))).drop("_h", "_own")


def assign_written_ids(df: DataFrame) -> DataFrame:
    """``assign_job_ids`` for rows that are stored: one narrow aggregate tells
    whether every record carries an object id of its own in its run.  Then the
    ids stand as they are and the rows are not shuffled for them."""
    own = F.when(valid_object_id("job_id"), F.xxhash64("run_id", F.lower("job_id")))
    ids = df.groupBy(own.alias("_own")).agg(F.count(F.lit(1)).alias("n"))
    unclear = ids.filter(F.col("_own").isNull() | (F.col("n") > 1)).limit(1).collect()
    return assign_job_ids(df) if unclear else df
