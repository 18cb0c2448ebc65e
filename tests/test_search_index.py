"""The trigram search against matching every query with every listing."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobgrid.operators import search, search_index
from jobgrid.operators.filters import java_pattern
from tests.test_patterns import CASES, TEXTS

KNOWN = {
    "gear": ["gear"], "GeAr|ring": ["gear", "ring"], "(red|blue) gear": ["blue gear", "red gear"], "red.*gear": ["gear"], "red": ["red"],
    "a|gear": None, "c+": None, ".*": None, "(gear)?": None, "(gear)+s": ["gear"], "gea?r": None, "[gG]ear": ["ear"], "^gear$": ["gear"],
    "(?=gear)ring": ["ring"], "gear{2}s": ["gear"], r"c\+\+ dev": ["c++ dev"], r"\x41bcd": ["bcd"], "a(b(c|d)|e)fg": ["abcfg", "abdfg", "aefg"], "": None,
    r"dev\b ops": [" ops"], "école": ["cole"], "x{0}abc": ["abc"], "(abc|)": None, "Skill": ["skill"],
}


def test_factors():
    for pattern, want in KNOWN.items():
        assert java_pattern(pattern) is not None
        got = search_index.factors(pattern)
        assert got == (sorted(want) if want else None), (pattern, got)


PIECES = st.sampled_from(["gear", "ring", "a", "re", "(", ")", "|", ".", "*", "+", "?", "{2}", "[ab]", "^", "$", "K", "s", "(?:", r"\d", r"\+", "é"])
SHOWN = ["gear", "ringgear", "rering", "aa gear", "b", "geargear", "GEAR", "ſring", "Kring", "a1", "+", "é", "gearr", "ring|a", ""]


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=8).map("".join), st.sampled_from(SHOWN))
def test_a_match_holds_a_factor(pattern, text):
    import re

    if java_pattern(pattern) is None or not (found := search_index.factors(pattern)):
        return
    try:
        hit = re.search(pattern, text, re.I)
    except re.error:
        return
    if hit:
        small = text.translate(str.maketrans(*search_index.FOLDED)).lower()
        assert any(f in small for f in found)


@pytest.fixture(scope="module")
def listings(spark):
    words = [*TEXTS, *SHOWN, *KNOWN, "red gear", "Blue Gear", "c++ dev", "abcd", "aefg", "İstanbul", "ıstanbul"]
    rows = [(w, words[-i % len(words)] if i % 3 else None, ["Pune", None, "gear"][i % 3]) for i, w in enumerate(words * 2)] + [(None, None, None)]
    return spark.createDataFrame(rows, "title string, company string, location string")


def test_equals_the_theta_join(spark, listings):
    queries = [*CASES, *KNOWN, "istan", "K", "skill", "ring|pune", "", "(", "zzz nothing", None, *(f"none{i}" for i in range(600))]
    log = spark.createDataFrame(list(enumerate(queries + queries[:5])), "request_id long, q string")
    got = {r.request_id: (r.q, r.results) for r in search_index.search_batch(listings, log).collect()}
    want = {r.request_id: (r.q, r.results) for r in search.search_batch(listings, log, 2000).collect()}
    assert got == want and len(got) == len(queries) + 5
    plan = search_index.query_hits(listings, log)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark, listings):
    none = spark.createDataFrame([], "request_id long, q string")
    assert search_index.search_batch(listings, none).collect() == []
    some = spark.createDataFrame([(1, "gear"), (2, ""), (3, "("), (4, ".")], "request_id long, q string")
    got = {r.q: r.results for r in search_index.search_batch(listings.limit(0), some).collect()}
    assert got == {"gear": 0, "": 0, "(": None, ".": 0}
