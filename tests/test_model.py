"""Sequential model checks: the set-form operators must equal applying the
batch one row at a time, as the reference does (plain-Python model)."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobgrid.operators import merge, saved

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "id string, seq int, k1 string, k2 string, v string"
KEYVAL = st.sampled_from(["a", "b", "", None])


def rows_strategy(prefix):
    return st.lists(st.tuples(KEYVAL, KEYVAL, st.sampled_from(["x", "y", "z", None])), max_size=8).map(
        lambda rs: [(f"{prefix}{i}", i, k1, k2, v) for i, (k1, k2, v) in enumerate(rs)]
    )


def model_upsert(target, batch, keys):
    idx = {"k1": 2, "k2": 3}
    rows = [list(r) for r in target]
    for b in batch:
        hit = next((r for r in rows if all(r[idx[k]] == b[idx[k]] for k in keys)), None)
        if hit is None:
            rows.append(list(b))
        else:
            hit[2], hit[3], hit[4] = b[2], b[3], b[4]
    return sorted(tuple(r) for r in rows)


@SETTINGS
@given(target=rows_strategy("t"), batch=rows_strategy("b"), keys=st.sampled_from([["k1"], ["k1", "k2"]]))
def test_upsert_equals_row_at_a_time(spark, target, batch, keys):
    batch = [(i, s + 100, k1, k2, v) for i, s, k1, k2, v in batch]  # batch rows come after the target
    t = spark.createDataFrame(target, SCHEMA)
    b = spark.createDataFrame(batch, SCHEMA)
    got = merge.upsert(t, b, keys, order=("seq",), id_col="id", written=["k1", "k2", "v"])
    assert sorted(tuple(r) for r in got.select("id", "seq", "k1", "k2", "v").collect()) == model_upsert(target, batch, keys)


@SETTINGS
@given(rows=rows_strategy("r"))
def test_dedupe_keeps_first_by_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("k1", "title").withColumnRenamed("k2", "company")
    kept, removed = merge.dedupe(df, order=("seq",), id_col="id")
    seen, want = set(), []
    for r in rows:
        key = f"{(r[2] or '').strip().lower()} @ {(r[3] or '').strip().lower()}"
        if key not in seen:
            seen.add(key)
            want.append(r[0])
    assert sorted(r.id for r in kept.collect()) == sorted(want)
    assert kept.count() + removed.count() == len(rows)


JOBS = ["j" * 23 + c for c in "abc"] + ["bad-id"]


def model_requests(saved0, reqs, listings):
    state = {(u, j): t for u, j, t in saved0}
    for rid, ts, u, action, j in sorted(reqs, key=lambda r: (r[1], r[0])):
        valid = len(j) == 24 and all(c in "0123456789abcdefABCDEF" for c in j)
        if not valid:
            continue
        if action == "save" and j in listings and (u, j) not in state:
            state[(u, j)] = ts
        elif action == "unsave":
            state.pop((u, j), None)
    return sorted((u, j, t) for (u, j), t in state.items())


@SETTINGS
@given(
    reqs=st.lists(
        st.tuples(st.integers(0, 1), st.sampled_from(["save", "unsave"]), st.sampled_from(JOBS), st.integers(0, 5)),
        max_size=12,
    ),
    pre=st.sets(st.tuples(st.integers(0, 1), st.sampled_from(JOBS[:3])), max_size=3),
)
def test_apply_requests_equals_sequential(spark, reqs, pre):
    base = dt.datetime(2024, 1, 1)
    listings = set(JOBS[:2])
    req_rows = [(i, base + dt.timedelta(minutes=m), u, a, j) for i, (u, a, j, m) in enumerate(reqs)]
    saved_rows = [(u, j, base - dt.timedelta(days=1)) for u, j in sorted(pre)]
    r = spark.createDataFrame(req_rows, "request_id long, ts timestamp_ntz, user_id long, action string, job_id string")
    s = spark.createDataFrame(saved_rows, "user_id long, job_id string, saved_at timestamp_ntz")
    lst = spark.createDataFrame([(j,) for j in sorted(listings)], "job_id string")
    got = saved.apply_requests(s, r, lst)
    assert sorted(tuple(x) for x in got.collect()) == model_requests(saved_rows, req_rows, listings)


def _valid(j):
    return len(j) == 24 and all(c in "0123456789abcdefABCDEF" for c in j)


def model_classify(pre, reqs, listings):
    state = set(pre)
    out = {}
    for rid, ts, u, a, j in sorted(reqs, key=lambda r: (r[1], r[0])):
        if not _valid(j):
            out[rid] = "invalid_id"
        elif a == "save":
            if j not in listings:
                out[rid] = "not_found"
            elif (u, j) in state:
                out[rid] = "already_saved"
            else:
                out[rid] = "created"
                state.add((u, j))
        else:
            if (u, j) in state:
                out[rid] = "removed"
                state.discard((u, j))
            else:
                out[rid] = "not_found"
    return out


@SETTINGS
@given(
    reqs=st.lists(
        st.tuples(st.integers(0, 1), st.sampled_from(["save", "unsave"]), st.sampled_from(JOBS), st.integers(0, 5)),
        max_size=12,
    ),
    pre=st.sets(st.tuples(st.integers(0, 1), st.sampled_from(JOBS[:3])), max_size=3),
)
def test_classification_equals_sequential(spark, reqs, pre):
    base = dt.datetime(2024, 1, 1)
    listings = set(JOBS[:2])
    req_rows = [(i, base + dt.timedelta(minutes=m), u, a, j) for i, (u, a, j, m) in enumerate(reqs)]
    r = spark.createDataFrame(req_rows, "request_id long, ts timestamp_ntz, user_id long, action string, job_id string")
    s = spark.createDataFrame([(u, j, base) for u, j in sorted(pre)], "user_id long, job_id string, saved_at timestamp_ntz")
    lst = spark.createDataFrame([(j,) for j in sorted(listings)], "job_id string")
    got_s = {x.request_id: x.status for x in saved.classify_saves(r, lst, s).collect()}
    got_u = {x.request_id: x.status for x in saved.classify_unsaves(r, lst, s).collect()}
    want = model_classify(pre, req_rows, listings)
    action = {x[0]: x[3] for x in req_rows}
    assert got_s == {i: x for i, x in want.items() if action[i] == "save"}
    assert got_u == {i: x for i, x in want.items() if action[i] == "unsave"}


@SETTINGS
@given(
    reqs=st.lists(st.tuples(st.integers(0, 1), st.sampled_from(JOBS), st.integers(0, 5)), max_size=10),
    init=st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["str", "job_id", "id"]), st.sampled_from(JOBS)),
                  max_size=4),
)
def test_embedded_save_equals_sequential(spark, reqs, init):
    from jobgrid.operators import users

    base = dt.datetime(2024, 1, 1)
    arrays = {0: [], 1: []}
    for u, kind, j in init:
        arrays[u].append({"str": None, "job_id": None, "id": None, "oid": None, kind: j})
    req_rows = [(i, base + dt.timedelta(minutes=m), u, "save", j) for i, (u, j, m) in enumerate(reqs)]
    model = {u: [dict(e) for e in arr] for u, arr in arrays.items()}
    for _, _, u, _, j in sorted(req_rows, key=lambda r: (r[1], r[0])):
        if not any(e["str"] == j or e["job_id"] == j or e["id"] == j for e in model[u]):
            model[u].append({"str": None, "job_id": j, "id": None, "oid": None})
    a = spark.createDataFrame([(u, arr) for u, arr in arrays.items()], f"user_id long, saved array<{users.ELEMENT}>")
    r = spark.createDataFrame(req_rows, "request_id long, ts timestamp_ntz, user_id long, action string, job_id string")
    got = {x.user_id: [e.asDict() for e in x.saved] for x in users.embedded_save(a, r).collect()}
    assert got == model
