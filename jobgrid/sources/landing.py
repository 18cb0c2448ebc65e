"""Landed response pages: the source config, the page window scan and the
page-failure policy (SURVEY §2.1).

``landing_pages(run_id, source, page, status, body, fetched_at)`` holds one
row per fetched (run, source, page).  On disk it is Parquet partitioned by
``source``; the window filter becomes a partition + row-group filter.

``build_landing`` derives such pages from the listing fixture for tests and
benchmarks: each (run, source, page) group is wrapped back into the source's
response shape.  ``run_id`` = ``scraped_date/<first shard_chars hex of
job_id>``, so one body holds a bounded slice of a day's page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed values of the sources: page windows, page sizes, failure policies,
# upsert keys, time encoding of the scrape time, and run order.
SOURCE_CONFIG = [
    # source, format, first_page, last_page, page_size, policy, keys, local_time, run_rank
    ("Internshala", "html", 1, 5, None, "skip", "job_url", True, 1),
    ("Unstop", "json", 1, 10, 20, "skip", "title,company", True, 2),
    ("Naukri", "json", 1, 5, 50, "skip", "title,company,job_url", False, 3),
    ("Indeed", "json", 1, 25, None, "stop", "", False, 4),
    ("LinkedIn", "html", 1, None, 25, "stop", "job_url", False, 5),
]
CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("first_page", T.IntegerType(), False),
        T.StructField("last_page", T.IntegerType(), True),
        T.StructField("page_size", T.IntegerType(), True),
        T.StructField("policy", T.StringType(), False),
        T.StructField("keys", T.StringType(), False),
        T.StructField("local_time", T.BooleanType(), False),
        T.StructField("run_rank", T.IntegerType(), False),
    ]
)
LOCAL_ZONE = "Asia/Kolkata"  # zone of the naive local scrape times (D7)
BAD_STATUS_PAGE = 4  # fixture: every source's page 4 answers 500

LANDING_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("body", T.StringType(), True),
        T.StructField("fetched_at", T.StringType(), True),
    ]
)


def source_config(spark: SparkSession) -> DataFrame:
    """The five-row source table (fixed size: safe to broadcast)."""
    return spark.createDataFrame(SOURCE_CONFIG, CONFIG_SCHEMA)


def _inside_window(landing: DataFrame, config: DataFrame) -> DataFrame:
    c = F.broadcast(config.select("source", "first_page", "last_page"))
    inside = (F.col("page") >= F.col("first_page")) & (F.col("page") <= F.coalesce("last_page", "page"))
    return landing.join(c, "source").withColumn("_inside", inside).drop("first_page", "last_page")


def scan_landing(landing: DataFrame, config: DataFrame, window: bool = False) -> DataFrame:
    """Landed pages of the known sources.  The page windows bound what is
    fetched; a page that has landed is data, so all are read unless ``window``
    asks for those inside (``outside_window`` gives the others)."""
    if not window:
        return landing.join(F.broadcast(config.select("source")), "source", "left_semi")
    return _inside_window(landing, config).filter("_inside").drop("_inside")


def outside_window(landing: DataFrame, config: DataFrame) -> DataFrame:
    """What ``scan_landing(window=True)`` leaves out, with the reason."""
    out = _inside_window(landing, config).filter(~F.col("_inside")).drop("_inside")
    return out.withColumn("reason", F.lit("outside the page window"))


def read_landing(spark: SparkSession, path: str, run_id: str | None = None,
                 config: DataFrame | None = None, window: bool = False) -> DataFrame:
    """Landing pages from Parquet (partitioned by ``source``); one run's pages
    when ``run_id`` is given (a pushed-down equality filter)."""
    df = spark.read.schema(LANDING_SCHEMA).parquet(path)
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    return scan_landing(df, config if config is not None else source_config(spark), window)


def policy_of(source: str) -> str:
    """The failure rule of a source; an unknown one skips."""
    return {s: policy for s, *_, policy, _, _, _ in SOURCE_CONFIG}.get(source, "skip")


def page_policy(pages: DataFrame, config: DataFrame, source: str | None = None) -> DataFrame:
    """The pages kept by each source's failure rule.

    ``pages`` holds one row per page with ``run_id, source, page`` and the
    flags ``bad`` and ``empty``, and may carry what was parsed from the page.
    *skip*: a bad page is dropped, later ones kept.  *stop*: nothing at or
    after the first bad or empty page of the run.

    When all rows are of one ``source``, a skipping one is a filter only.  A
    stopping one looks back over the pages of its (run, source), a group as
    large as one crawl; pages are parsed once and nothing runs while the plan
    is built."""
    failed = F.col("bad") | F.col("empty")
    if source is not None and policy_of(source) == "skip":
        return pages.filter(~F.col("bad"))
    stop = F.lit(True)
    if source is None:
        pages = pages.join(F.broadcast(config.select("source", "policy")), "source")
        stop = F.col("policy") == "stop"
    crawl = Window.partitionBy("run_id", "source")
    first = F.min(F.when(stop & failed, F.col("page"))).over(crawl)
    keep = F.when(stop, F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).otherwise(~F.col("bad"))
    return pages.withColumn("_stop", first).filter(keep).drop("_stop", "policy")


# ---- fixture bodies ---------------------------------------------------------------


def _esc(c: Column) -> Column:
    """HTML text escaping."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _el(tag: str, attrs: str, v: Column) -> Column:
    """``<tag attrs>v</tag>``, or '' when v is null (element absent)."""
    return F.coalesce(F.concat(F.lit(f"<{tag}{attrs}>"), _esc(v), F.lit(f"</{tag}>")), F.lit(""))


PAGE_SIZE = 25  # records per fixture body, the page size of the sources


def shard_chars(listings: DataFrame, page_size: int = PAGE_SIZE) -> int:
    """Hex digits of ``job_id`` that split a (source, month, page) group into
    bodies of at most ``page_size`` records on average: 0, 1 (16 shards),
    2 (256), ...  One aggregate, one number to the driver."""
    row = listings.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source", F.substring(F.col("scraped_date").cast("string"), 1, 7), "page").alias("g"),
    ).first()
    n, g = int(row["n"]), max(int(row["g"]), 1)
    k = 0
    while n > g * page_size * (16**k):
        k += 1
    return k


def run_id_expr(k: int) -> Column:
    month = F.substring(F.col("scraped_date").cast("string"), 1, 7)
    return F.concat(month, F.lit("/"), F.substring("job_id", 1, k))


def build_landing(listings: DataFrame, k: int | None = None) -> DataFrame:
    """Wrap fixture listings back into each source's response pages: one run
    per month (and job-id shard), one body per (run, source, page).

    The listings are shuffled once, as they are: a partial list before the
    shuffle would shrink nothing, and what a record derives from its columns is
    made after it."""
    k = shard_chars(listings) if k is None else k
    base = listings.repartition(run_id_expr(k), "source", "page").withColumn("run_id", run_id_expr(k))
    p, src = F.col("page"), F.col("source")
    names = ("job_id", "title", "company", "location", "stipend", "duration", "job_url")
    r = {c: F.col(c) for c in names} | {
        "day": F.col("scraped_date").cast("string"),
        "loc1": F.split_part(F.col("location"), F.lit(", "), F.lit(1)),
        "loc2": F.split_part(F.col("location"), F.lit(", "), F.lit(2)),
    }

    # Each record is written once, as a row; a body joins the texts of its records.

    # Naukri: {"results": [...]}; company an object on odd pages, location on pages 3, 6.
    def naukri(obj_company: bool, obj_location: bool) -> Column:
        company = F.struct(r["company"].alias("display_name")) if obj_company else r["company"]
        location = F.struct(r["location"].alias("display_name")) if obj_location else r["location"]
        return F.to_json(F.struct(
            r["job_id"].alias("id"), r["title"].alias("title"), company.alias("company"),
            location.alias("location"), r["job_url"].alias("redirect_url"),
            F.concat(r["day"], F.lit("T00:00:00Z")).alias("created"),
            F.concat(F.lit("Role: "), r["title"]).alias("description"),
        ))

    naukri_rec = (
        F.when((p % 2 == 1) & (p % 3 == 0), naukri(True, True))
        .when(p % 2 == 1, naukri(True, False))
        .when(p % 3 == 0, naukri(False, True))
        .otherwise(naukri(False, False))
    )

    # Unstop: data.data[] (odd pages) / data[] (page 2) / records[] (page 6)
    def unstop(org_string: bool, city: bool) -> Column:
        org = r["company"] if org_string else F.struct(r["company"].alias("name"))
        locs = F.when(
            r["location"].isNotNull(),
            F.array(F.struct(r["loc1"].alias("city"), F.lit("").alias("state"), r["loc2"].alias("country"))),
        )
        fields = [r["job_id"].alias("id"), r["title"].alias("title"), org.alias("organisation")]
        fields += [r["location"].alias("city")] if city else [locs.alias("locations")]
        fields += [
            r["stipend"].alias("salary"),
            F.when(p % 2 == 0, F.lit("Full-time Job")).otherwise(F.lit("Internship")).alias("job_type"),
            F.when(F.coalesce(r["job_url"], F.lit("")) != "", F.concat(F.lit("jobs/"), r["job_id"]))
            .otherwise(F.lit(""))
            .alias("public_url"),
        ]
        return F.to_json(F.struct(*fields))

    unstop_rec = F.when(p.isin(1, 2), unstop(False, True)).when(p == 3, unstop(True, False)).otherwise(unstop(False, False))

    # Indeed: {"data": {"jobs": [...]}}
    lo = F.when(p == 7, F.lit(None)).when(p == 6, F.lit(0)).otherwise(p * 100000)
    indeed_rec = F.to_json(F.struct(
        r["job_id"].alias("id"), r["title"].alias("job_title"), r["company"].alias("employer_name"),
        F.when(p != 2, r["loc1"]).alias("job_city"),
        F.when(p.isin(1, 5), r["loc2"]).alias("job_state"),
        F.when(p == 3, F.lit("IN")).alias("job_country"),
        F.when(p != 6, F.concat(r["day"], F.lit("T08:00:00.000Z"))).alias("job_posted_at_datetime_utc"),
        lo.alias("job_min_salary"),
        F.when(p.isin(1, 2, 5), p * 150000).alias("job_max_salary"),
        F.when(p != 2, F.lit("YEAR")).alias("job_salary_period"),
        F.when(p == 5, F.lit("USD")).alias("job_salary_currency"),
        r["job_url"].alias("job_apply_link"),
        F.concat(F.lit("Build "), r["title"], F.lit(" "), F.repeat(F.lit("x"), p * 60)).alias("job_description"),
    ))

    # Internshala: div.individual_internship cards
    def intern_card():
        title = F.when(p % 2 == 1, _el("h3", ' class="job-internship-name"', r["title"])).otherwise(
            _el("p", ' class="profile"', r["title"])
        )
        company = F.when(p % 3 == 0, _el("a", ' class="company_name"', r["company"])).otherwise(
            _el("p", ' class="company-name"', r["company"])
        )
        location = F.when(p % 2 == 0, _el("span", ' id="location_names"', r["location"])).otherwise(
            F.coalesce(
                F.concat(F.lit('<div class="location_names"><a>'), _esc(r["location"]), F.lit("</a></div>")),
                F.lit(""),
            )
        )
        bodies = (
            F.when(p == 1, F.lit(""))
            .when(p == 2, _el("div", ' class="item_body"', r["duration"]))
            .otherwise(F.concat(F.lit('<div class="item_body">Immediately</div>'), _el("div", ' class="item_body"', r["duration"])))
        )
        href = (
            F.when(r["job_url"].isNull(), F.lit(""))
            .when(r["job_url"] == "", F.lit('<a href="https://other.example.com/apply">Apply</a>'))
            .when(p % 2 == 1, F.concat(F.lit('<a href="/internship/detail/'), r["job_id"], F.lit('">View</a>')))
            .otherwise(F.concat(F.lit('<a href="https://internshala.com/internship/detail/'), r["job_id"], F.lit('">View</a>')))
        )
        return F.concat(
            F.lit('<div class="individual_internship"><meta itemprop="identifier" content="'), r["job_id"],
            F.lit('"><a href="/company/profile">Company</a>'),
            title, company, location, _el("span", ' class="stipend"', r["stipend"]), bodies, href, F.lit("</div>"),
        )

    # LinkedIn: li.result-card cards
    def linkedin_card():
        link = F.when(r["job_url"].isNull(), F.lit("")).otherwise(
            F.concat(F.lit('<a class="result-card__full-card-link" href="'), _esc(r["job_url"]), F.lit('">Open</a>'))
        )
        return F.concat(
            F.lit('<li class="result-card job-result-card"><meta itemprop="identifier" content="'), r["job_id"],
            F.lit('">'),
            _el("h3", ' class="result-card__title"', r["title"]),
            _el("h4", ' class="result-card__subtitle"', r["company"]),
            _el("span", ' class="job-result-card__location"', r["location"]),
            link, F.lit("</li>"),
        )

    bad = p == BAD_STATUS_PAGE
    card = (
        F.when(src == "Naukri", naukri_rec)
        .when(src == "Unstop", unstop_rec)
        .when(src == "Indeed", indeed_rec)
        .when(src == "Internshala", intern_card())
        .otherwise(linkedin_card())
    )
    # the columns order the records of a body; equal columns make equal texts
    rec = F.struct(*names, "scraped_date", F.when(bad, F.lit(None)).otherwise(card).alias("text"))
    grouped = base.groupBy("run_id", "source", "page").agg(
        F.sort_array(F.collect_list(rec)).alias("recs"), F.min("scraped_date").alias("day")
    )
    day = F.col("day").cast("string")  # the run's fetch day: first day of the group

    def wrap(head: str, sep: str, foot: str) -> Column:
        return F.concat(F.lit(head), F.array_join("recs.text", sep), F.lit(foot))

    naukri_body = wrap('{"results":[', ",", "]}")
    # a malformed body (fixture: March runs, page 2) is a failed page
    naukri_body = F.when(
        F.col("run_id").contains("-03/") & (p == 2), F.substring(naukri_body, 1, 20)
    ).otherwise(naukri_body)
    unstop_body = (
        F.when(p == 2, wrap('{"data":[', ",", "]}"))
        .when(p == 6, wrap('{"data":{},"records":[', ",", "]}"))
        .otherwise(wrap('{"data":{"data":[', ",", "]}}"))
    )
    body = (
        F.when(src == "Naukri", naukri_body)
        .when(src == "Unstop", unstop_body)
        .when(src == "Indeed", wrap('{"data":{"jobs":[', ",", "]}}"))
        .when(src == "Internshala", wrap('<html><body><div id="internship_list">', "", "</div></body></html>"))
        .otherwise(wrap('<html><body><ul class="jobs-search__results-list">', "", "</ul></body></html>"))
    )
    local_fmt = F.concat(day, F.lit(" 11:30:00"))  # 06:00 UTC in the local zone
    utc_fmt = F.concat(day, F.lit("T06:00:00.000000"))
    return grouped.select(
        "run_id",
        "source",
        p.cast("int").alias("page"),
        F.when(bad, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(bad, F.lit("<html><body>Server error</body></html>")).otherwise(body).alias("body"),
        F.when(src.isin("Internshala", "Unstop"), local_fmt).otherwise(utc_fmt).alias("fetched_at"),
    )
