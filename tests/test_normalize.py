"""Golden edge cases for page policy, JSON record paths, string-or-object
fields and the HTML card extractor (hand-written bodies)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from jobgrid.functions.text import salary_text
from jobgrid.operators import normalize as N
from jobgrid.sources import html as H
from jobgrid.sources.landing import LANDING_SCHEMA, outside_window, scan_landing, source_config


def landing(spark, rows):
    """rows: (source, page, status, body)."""
    data = [("r1", s, p, st, b, "2024-01-01 11:30:00" if s in ("Internshala", "Unstop") else "2024-01-01T06:00:00")
            for s, p, st, b in rows]
    return spark.createDataFrame(data, LANDING_SCHEMA)


def norm(spark, source, rows):
    cfg = source_config(spark)
    out, rej = N.normalize(scan_landing(landing(spark, rows), cfg), source, cfg)
    return sorted((r.asDict() for r in out.collect()), key=lambda r: (r["page"], r["pos"])), rej.collect()


def test_unstop_shapes_and_rules(spark):
    recs = [
        {"title": "A", "organisation": {"name": "Org"}, "city": "Pune", "job_type": "Full-time Job", "public_url": "x"},
        {"title": "", "organisation": {"name": "Dropped"}},
        {"title": "B", "organisation": "plain", "locations": [{"city": "Delhi", "country": "India"}]},
        {"title": "C", "city": {"city": "", "state": "", "country": ""}, "salary": "10k"},
        {"title": "D", "city": "", "locations": []},
        {"title": "E", "job_type": None},
    ]
    rows = [
        ("Unstop", 1, 200, json.dumps({"data": {"data": recs[:2]}})),
        ("Unstop", 2, 200, json.dumps({"data": recs[2:4]})),
        ("Unstop", 3, 200, json.dumps({"data": {}, "records": recs[4:]})),
    ]
    out, rej = norm(spark, "Unstop", rows)
    by = {r["title"]: r for r in out}
    assert set(by) == {"A", "B", "C", "D"}  # '' dropped, null job_type rejected
    assert by["A"]["company"] == "Org" and by["A"]["location"] == "Pune"
    assert by["A"]["duration"] == "Permanent" and by["A"]["job_url"] == "https://unstop.com/x"
    assert by["B"]["company"] == "N/A" and by["B"]["location"] == "Delhi, , India"
    assert by["B"]["duration"] == "3 Months" and by["B"]["job_url"] == "https://unstop.com"
    assert by["C"]["location"] == "" and by["C"]["stipend"] == "10k"  # an all-empty object strips to ''
    assert by["D"]["location"] == "Remote" and by["D"]["stipend"] == "Not Disclosed"
    assert [r["reason"] for r in rej] == ["null job_type"]


def test_naukri_string_or_object(spark):
    recs = [
        {"title": "T1", "company": {"display_name": "Acme"}, "location": "Pune", "redirect_url": "u1"},
        {"title": "T2", "company": "Plain Co", "location": {"display_name": "Delhi"}},
        {"title": None, "company": {}},
    ]
    out, _ = norm(spark, "Naukri", [("Naukri", 1, 200, json.dumps({"results": recs}))])
    assert [(r["title"], r["company"], r["location"]) for r in out] == [
        ("T1", "Acme", "Pune"), ("T2", "Plain Co", "Delhi"), (None, None, None)
    ]


def test_indeed_rules_and_stop_policy(spark):
    rec = {
        "job_title": "Dev", "job_city": "", "job_state": "KA", "job_min_salary": 100, "job_max_salary": 200,
        "job_salary_period": "YEAR", "job_posted_at_datetime_utc": "2024-02-03T04:05:06Z", "job_description": "x" * 301,
    }
    rec2 = {"job_min_salary": 0, "job_max_salary": 5, "job_country": "US"}
    rows = [
        ("Indeed", 1, 200, json.dumps({"data": {"jobs": [rec, rec2]}})),
        ("Indeed", 2, 200, json.dumps({"data": {"jobs": []}})),  # empty page ends the source
        ("Indeed", 3, 200, json.dumps({"data": {"jobs": [rec]}})),
    ]
    out, _ = norm(spark, "Indeed", rows)
    assert len(out) == 2 and {r["page"] for r in out} == {1}
    a, b = out
    assert a["location"] == "KA" and a["stipend"] == "INR 100 - 200 / YEAR" and a["date_posted"] == "2024-02-03"
    assert a["job_description_snippet"] == "x" * 300 + "..."
    assert b["title"] == "N/A" and b["company"] == "N/A" and b["job_url"] == "N/A"
    assert b["location"] == "US" and b["stipend"] == "Not Disclosed" and b["date_posted"] == "N/A"


def test_skip_policy_and_malformed_body(spark):
    good = json.dumps({"results": [{"title": "ok"}]})
    rows = [("Naukri", 1, 200, good), ("Naukri", 2, 200, good[:10]), ("Naukri", 3, 500, good), ("Naukri", 4, 200, good)]
    out, _ = norm(spark, "Naukri", rows)
    assert [r["page"] for r in out] == [1, 4]


def test_page_window(spark):
    """All landed pages are read; the fetch window is an option that says what it leaves out."""
    good = json.dumps({"results": [{"title": "ok"}]})
    rows = [("Naukri", p, 200, good) for p in range(1, 8)]
    out, _ = norm(spark, "Naukri", rows)
    assert [r["page"] for r in out] == [1, 2, 3, 4, 5, 6, 7]
    pages, cfg = landing(spark, rows), source_config(spark)
    assert sorted(r.page for r in scan_landing(pages, cfg, window=True).collect()) == [1, 2, 3, 4, 5]
    assert sorted((r.page, r.reason) for r in outside_window(pages, cfg).collect()) == [(6, "outside the page window"), (7, "outside the page window")]


def test_internshala_cards(spark):
    body = """<html><body><div class="individual_internship"><a href="/company/x">c</a>
      <h3 class="job-internship-name">  Data <b>Intern</b> </h3><p class="company-name">Acme &amp; Co</p>
      <div class="item_body">Now</div><div class="item_body"> 6 Months </div>
      <a href="/internship/detail/abc">View</a></div>
      <div class="individual_internship"><p class="company-name">No title</p></div>
      <div class="individual_internship"><p class="profile">Second</p><span id="location_names">Pune</span>
      <div class="item_body">2 Months</div><a href="https://other/x">x</a>
      </body></html>"""
    out, _ = norm(spark, "Internshala", [("Internshala", 1, 200, body)])
    assert [(r["title"], r["company"], r["location"], r["stipend"], r["duration"], r["job_url"]) for r in out] == [
        ("DataIntern", "Acme & Co", "Remote", "Unpaid", "6 Months", "https://internshala.com/internship/detail/abc"),
        ("Second", "N/A", "Pune", "Unpaid", "2 Months", ""),
    ]
    assert [r["pos"] for r in out] == [0, 2]  # the title-less card keeps its position


def test_linkedin_defaults_and_stop_on_empty(spark):
    card = ('<li class="result-card"><h3 class="result-card__title">T</h3>'
            '<a class="result-card__full-card-link" href="">go</a></li>')
    rows = [
        ("LinkedIn", 1, 200, f"<ul>{card}{card}</ul>"),
        ("LinkedIn", 2, 200, "<ul></ul>"),
        ("LinkedIn", 3, 200, f"<ul>{card}</ul>"),
    ]
    out, _ = norm(spark, "LinkedIn", rows)
    assert [(r["page"], r["title"], r["company"], r["location"], r["job_url"]) for r in out] == [
        (1, "T", "N/A", "N/A", ""), (1, "T", "N/A", "N/A", "")
    ]


def test_dom_tolerates_unclosed_tags():
    root = H.parse("<div class=a><p>one<p>two</div><div class=a><span>three")
    cards = H.select(root, "div.a")
    assert [H.text(c) for c in cards] == ["onetwo", "three"]
    assert [H.text(x) for x in H.select(root, "div p")] == ["onetwo", "two"]


def test_selector_subset():
    root = H.parse('<nav><ul><li><a href="/x">X</a></li></ul></nav><ul><li>out</li></ul><i id="k" data-v></i>')
    assert [H.text(x) for x in H.select(root, "nav li")] == ["X"]
    assert len(H.select(root, "#k")) == 1 and len(H.select(root, "i[data-v]")) == 1


def test_salary_numbers_print_as_the_source_prints_them(spark):
    cases = {"50000.0": "50000.0", "1e7": "10000000.0", "50000": "50000", '"9k"': "9k", "1234.50": "1234.5", "1.5e20": "1.5e+20",
             "0.0": "0.0", "0": "0", "12345678.25": "12345678.25", "null": None}
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r.j: r.t for r in rows.select("j", N.number_text(F.try_parse_json("j")).alias("t")).collect()}
    assert got == cases
    text = rows.select("j", salary_text(N.number_text(F.try_parse_json("j")), F.lit(None).cast("string"), F.lit("YEAR"), F.lit(None).cast("string")).alias("t"))
    got = {r.j: r.t for r in text.collect()}
    assert got["50000.0"] == "INR 50000.0 / YEAR" and got["0.0"] == got["0"] == got["null"] == "Not Disclosed"


def test_pages_are_parsed_once_and_only_when_the_plan_runs(spark):
    card = '<li class="result-card"><h3 class="result-card__title">T</h3></li>'
    pages = landing(spark, [("LinkedIn", 1, 200, card), ("LinkedIn", 2, 429, card), ("Internshala", 1, 200, "")])
    cfg = source_config(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    try:
        plans = {s: N.normalize(pages, s, cfg)[0] for s in ("LinkedIn", "Internshala", "Indeed", "Unstop")}
        shown = {s: df._jdf.queryExecution().executedPlan().toString() for s, df in plans.items()}
        assert not list(tracker.getJobIdsForGroup("plan-only"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert shown["LinkedIn"].count("MapInPandas") == 1 and shown["Internshala"].count("MapInPandas") == 1
    assert "Exchange" not in shown["Internshala"] and "Exchange" not in shown["Unstop"]
    assert shown["Indeed"].count("try_parse_json") + shown["Indeed"].count("parse_json") <= 2


def test_stop_looks_at_its_own_run_only(spark):
    good = json.dumps({"data": {"jobs": [{"job_title": "ok"}]}})
    rows = [("r1", "Indeed", p, 200 if p != 2 else 500, good, "2024-01-01T06:00:00") for p in (1, 2, 3)]
    rows += [("r2", "Indeed", p, 200, good, "2024-01-01T06:00:00") for p in (1, 2, 3)]
    cfg = source_config(spark)
    out = N.normalize(spark.createDataFrame(rows, LANDING_SCHEMA), "Indeed", cfg)[0]
    assert sorted((r.run_id, r.page) for r in out.collect()) == [("r1", 1), ("r2", 1), ("r2", 2), ("r2", 3)]


def test_ids_are_object_ids_and_unique(spark):
    hexed = "0123456789abcdef01234567"
    rows = [("r1", "Naukri", 1, i, "t", "c", "u", i_id) for i, i_id in enumerate(["12", "12", None, hexed, hexed, hexed.upper(), "job-7"])]
    rows += [("r2", "Naukri", 1, 0, "t", "c", "u", "12")]
    df = spark.createDataFrame(rows, "run_id string, source string, page int, pos int, title string, company string, job_url string, job_id string")
    ids = [r.job_id for r in N.assign_job_ids(df).orderBy("run_id", "pos").collect()]
    assert len(set(x.lower() for x in ids)) == len(ids) and all(len(x) == 24 and int(x, 16) >= 0 for x in ids)
    assert ids[3] == hexed
    assert ids == [r.job_id for r in N.assign_job_ids(df.repartition(5)).orderBy("run_id", "pos").collect()]


def test_plain_markup_gives_the_tree_of_the_parser():
    def shape(n):
        return n.tag, n.attrs, n.cls, [c if isinstance(c, str) else shape(c) for c in n.children]

    def parsed(body):
        b = H._Builder()
        b.feed(body)
        b.close()
        return b.root

    plain = ['<ul><li class="a b">x &amp; y &lt z<br>t</li></ul>tail & co', '<p class="a" class="b"><b>x</p>y</i>', "", "no tags",
             '<a href="/q?a=1&amp;b=&quot;2&quot;"></a><meta itemprop="i" content="1"><div id="d">\n é </div>']
    other = ["<P>x</P>", "a < b", "<p", "<!-- c --><p>x</p>", "<a href=x>y</a>", "<br/>z", '<a href="?a=1&copy=2">y</a>',
             "<script>if (a<b) x()</script>", "<style>p { }</style><p>x</p>", "<p\nclass='a'>x</p>", "<title><b>x</b></title>", "x &amp"]
    for body in plain:
        assert H._parse_plain(body) is not None and shape(H.parse(body)) == shape(parsed(body))
    for body in other:
        assert shape(H.parse(body)) == shape(parsed(body))


def test_json_bodies_are_parsed_once(spark):
    for source, body in (("Unstop", '{"data":{"data":[{"title":"t"}]}}'), ("Naukri", '{"results":[{"title":"t"}]}')):
        rows = [("r", source, 1, 200, body, "2024-01-01 00:00:00"), ("r", source, 2, 200, "{", None), ("r", source, 3, 500, body, None),
                ("r", source, 4, 200, '{"results":[]}', None)]
        recs = N.json_records(spark.createDataFrame(rows, LANDING_SCHEMA), source, source_config(spark))
        plan = recs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parse_json") + plan.count("parseJson") == 1, plan
        assert [(r["page"], r["pos"]) for r in recs.collect()] == [(1, 0)]


def test_written_rows_with_clear_ids_are_not_shuffled(spark):
    def rows(*ids):
        data = [(i, "r1" if k < 3 else "r2", 1, k, f"t{k % 2}", "c", "u", "Naukri") for k, i in enumerate(ids)]
        return spark.createDataFrame(data, "job_id string, run_id string, page int, pos int, title string, company string, job_url string, source string")

    a, b, c = ("a" * 24, "b" * 24, "c" * 24)
    clear = rows(a, b, c, a)  # an id may come again in another run
    kept = N.assign_written_ids(clear)
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(kept.collect()) == sorted(N.assign_job_ids(clear).collect())
    for ids in ((a, b, None, c), (a, b, a, c), (a, "x", b, c), (a, a.upper(), b, c)):
        got = N.assign_written_ids(rows(*ids))
        assert sorted(got.collect()) == sorted(N.assign_job_ids(rows(*ids)).collect())
        assert got.groupBy("run_id", "job_id").count().filter("count > 1").count() == 0
