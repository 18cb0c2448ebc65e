"""The saved elements against serving the requests one by one."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from jobgrid.operators import saved_elements


def served(arrays: dict, requests: list) -> dict:
    """Row-at-a-time model; returns the status of each request."""
    said = {}

    def same(a, b):
        return type(a) is type(b) and a == b

    for rid, user, action, value in requests:
        mine = arrays.setdefault(user, [])
        if action == "save":
            job = value
            if not job:
                said[rid] = "empty"
                continue
            check = (job.get("jobId") or job.get("id")) if isinstance(job, dict) else job
            if check and any(same(x, check) if isinstance(x, str) else same(x.get("jobId"), check) or same(x.get("id"), check) for x in mine):
                said[rid] = "already_saved"
                continue
            mine.append(job)
            said[rid] = "created"
        else:
            keep = [x for x in mine if not (same(x, value) if isinstance(x, str) else any(same(x.get(k), value) for k in ("jobId", "id", "_id")))]
            said[rid] = "not_found" if len(keep) == len(mine) else "removed"
            mine[:] = keep
    return said


def _job(r: random.Random):
    ids = ["a", "b", "c", "d", 5, 0, "", "5"]
    kind = r.randrange(7)
    if kind == 0:
        return r.choice("abcd")
    if kind == 1:
        return {"title": r.choice(["x", "y"])}
    if kind == 2:
        return {"_id": r.choice("abcd"), "title": "z"}
    if kind == 3:
        return {"id": r.choice(ids), "jobId": r.choice(ids)}
    if kind == 4:
        return r.choice([None, {}, ""])
    return {r.choice(["id", "jobId"]): r.choice(ids), "pay": {"n": r.randrange(3), "tags": ["p", "q"]}}


def test_requests_one_by_one(spark):
    r = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    arrays: dict = {}
    had = []
    for user in range(12):
        for n in range(r.randrange(4)):
            job = _job(r) or "a"
            arrays.setdefault(user, []).append(job)
            had.append((user, 0, start, n, json.dumps(job)))
    had.append((99, 0, start, 0, '{"jobId":"a"}'))
    arrays[99] = [{"jobId": "a"}]
    requests = []
    for rid in range(600):
        user = 0 if r.random() < 0.4 else r.randrange(14)
        if r.random() < 0.6:
            requests.append((rid, user, "save", _job(r)))
        else:
            requests.append((rid, user, "unsave", r.choice(["a", "b", "c", "d", "5", "zz"])))
    said = served(arrays, requests)
    elements = spark.createDataFrame(had, "user_id long, batch long, ts timestamp_ntz, n long, e string").withColumn("element", F.parse_json("e"))
    rows = [(rid, user, start + dt.timedelta(seconds=rid // 3), a, json.dumps(v) if a == "save" else None, v if a == "unsave" else None) for rid, user, a, v in requests]
    asked = spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp_ntz, action string, b string, target string")
    asked = asked.withColumn("body", F.parse_json("b")).repartition(5)
    after, statuses = saved_elements.apply(elements.drop("e"), asked, 1)
    assert {x.request_id: x.status for x in statuses.collect()} == said
    got = {x.user_id: (x.n_saved, json.loads(x.saved)) for x in saved_elements.arrays(after).collect()}
    assert got == {u: (len(v), v) for u, v in arrays.items() if v}


def test_empty_tables(spark):
    elements = spark.createDataFrame([], "user_id long, batch long, ts timestamp_ntz, n long, e string").select("user_id", "batch", "ts", "n", F.parse_json("e").alias("element"))
    asked = spark.createDataFrame([], "request_id long, user_id long, ts timestamp_ntz, action string, b string, target string").withColumn("body", F.parse_json("b"))
    after, statuses = saved_elements.apply(elements, asked, 1)
    assert after.count() == statuses.count() == 0
