"""Many runs as one plan against the runs one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from jobgrid.operators.components import components
from jobgrid.plans import ingest
from jobgrid.plans.ingest import RUN_ORDER, empty_listings, ingest_run
from jobgrid.session import cut_lineage
from jobgrid.sources.landing import source_config
from tests.test_ingest import indeed, linkedin, naukri, pages

HOST = "https://internshala.com/internship/detail/"


def internshala(*jobs) -> str:
    card = '<div class="individual_internship"><h3 class="job-internship-name">{}</h3><p class="company-name">{}</p>{}</div>'
    link = '<a href="{}">x</a>'
    return "".join(card.format(t, c, link.format(u) if u.startswith(HOST) else "") for t, c, u in jobs)


def unstop(*jobs) -> str:
    import json

    return json.dumps({"data": [{"title": t, "organisation": {"name": c}, "public_url": u[-1:]} for t, c, u in jobs]})


BODY = {"Internshala": internshala, "Unstop": unstop, "Naukri": naukri, "Indeed": indeed, "LinkedIn": linkedin}
TITLES, COMPANIES = ["a", " A", "b", "c", "d"], ["X", "x ", "Y"]
URLS = [HOST + "1", HOST + "2", "", "https://unstop.com/1", "u5", "u6", "u7", *[f"only{i}" for i in range(400)]]


def random_pages(seed: int, n_runs: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for run in range(n_runs):
        for source, body in BODY.items():
            if r.random() < 0.25:
                continue
            for page in range(1, r.randrange(2, 4)):
                # half of a run's records share one title and company
                jobs = [(r.choice(TITLES) if r.random() < 0.5 else "hot", r.choice(COMPANIES) if r.random() < 0.5 else "H",
                         r.choice(URLS[:7]) if r.random() < 0.6 else r.choice(URLS)) for _ in range(r.randrange(0, 9))]
                out.append((f"r{run}", source, page, 200 if r.random() < 0.9 else 500, body(*jobs)))
    return out


def shown(df) -> list:
    return sorted((tuple(x) for x in df.select(*sorted(df.columns)).collect()), key=repr)


def test_one_plan_equals_runs_one_by_one(spark):
    for seed in (1,):  # 0, 1 and 2 were run; a seed takes over a minute
        rows = random_pages(seed, 4)
        cfg, want, removed = source_config(spark), empty_listings(spark), []
        for run in sorted({x[0] for x in rows}):
            # each run alone, in set form, source after source
            res = ingest_run(want, pages(spark, *(x for x in rows if x[0] == run)), cfg, (*RUN_ORDER, "LinkedIn"), by_run=False)
            assert not res.errors
            removed.append(res.removed.count())
            want = cut_lineage(res.listings)
        one = ingest_run(empty_listings(spark), pages(spark, *rows), cfg, (*RUN_ORDER, "LinkedIn"))
        assert shown(one.listings.select(*want.columns)) == shown(want)
        assert one.removed.count() == sum(removed)
        # on a table that is there already, and not yet deduplicated
        double = want.unionByName(want.withColumn("job_id", F.concat(F.lit("x"), "job_id")))
        more = pages(spark, *random_pages(seed + 50, 1))
        a = ingest_run(double, more, cfg, None, by_run=False)
        b = ingest_run(double, more, cfg, None)
        assert shown(a.listings.select(*want.columns)) == shown(b.listings.select(*want.columns))


def test_jobs_do_not_grow_with_the_runs(spark):
    def jobs(n):
        group = f"replay-{n}"
        spark.sparkContext.setJobGroup(group, "")
        rows = [(f"r{i:02}", "Naukri", 1, 200, naukri((f"t{i % 3}", "c", "u"))) for i in range(n)]
        ingest_run(empty_listings(spark), pages(spark, *rows), source_config(spark), ("Naukri",)).listings.collect()
        spark.sparkContext.setJobGroup("", "")
        return len(list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))

    assert jobs(12) <= jobs(2) + 2


def test_hot_titles_are_settled_without_a_replay(spark):
    from jobgrid.operators import normalize as N
    from jobgrid.plans import replay as R

    rows = [("r1", "Naukri", 1, 200, naukri(*(("hot", "H", f"only{i}") for i in range(500))))]
    got = N.normalize(pages(spark, *rows), "Naukri", source_config(spark))[0]
    got = ingest.with_insert_seq(N.assign_job_ids(got)).withColumn("run_no", F.lit(0)).withColumn("src_no", F.lit(0))
    link = got.withColumn("_link", R._key_hash("job_url"))
    marked = R.with_settled(link, link.limit(0))
    assert marked.filter("_settled").count() == 498
    one = ingest_run(empty_listings(spark), pages(spark, *rows), source_config(spark), ("Naukri",))
    assert [(r.title, r.pos) for r in one.listings.collect()] == [("hot", 0)] and one.removed.count() == 499


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(120)]
    links += [(5000, x) for x in range(5001, 5300)] + [(7777, 7777)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


def test_records_are_shuffled_once_to_be_settled(spark):
    from jobgrid.plans import replay as R

    got = R._keyed(empty_listings(spark)).withColumns({"run_no": F.lit(0), "src_no": F.lit(0)})
    kept = R.with_settled(got, got.limit(0)).filter("NOT _settled")
    plan = kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert plan.count("WindowGroupLimit") == 2  # cut before the shuffle, and after


def test_a_row_is_looked_for_by_its_link_only_if_another_may_have_it():
    from jobgrid.plans.replay import Component

    cols = ["job_id", "title", "company", "job_url", "source"]
    rules = [("A", ["job_url"], cols[1:]), ("B", ["title", "company"], cols[1:])]
    c = Component(cols, rules, {}, 2)
    c.apply(0, {"A": [(["1", "t", "c", "u", "A"], (1,), "t @ c", True), (["2", "x", "c", "v", "A"], (2,), "x @ c", False)]})
    assert not any("u" in e for e in c.keys) and any("v" in e for e in c.keys)
    c.apply(1, {"A": [(["3", "y", "c", "v", "A"], (3,), "y @ c", False)], "B": [(["4", "t", "c", "w", "B"], (4,), "t @ c", True)]})
    assert sorted(c.finish()) == [["1", "t", "c", "w", "B"], ["2", "y", "c", "v", "A"]]
