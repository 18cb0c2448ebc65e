"""User patterns mean what they mean in JavaScript and never break a job."""

from __future__ import annotations

import pytest

from jobgrid.operators.filters import check_pattern, java_pattern
from jobgrid.operators.search import search_batch

#: pattern: texts it finds among TEXTS, None if JavaScript rejects it
TEXTS = ["dev", "c++ [x]", "a{,2}", "p{L}", "end\n", "bb", "ab"]
CASES = {
    "[[]": ["c++ [x]"], "a{,2}": ["a{,2}"], r"\p{L}": ["p{L}"], "(?<n>dev)": ["dev"], "d$": ["end\n"][:0], "c++": None, "(a)?(?(1)b|c)": None,
    "(?P<n>a)": None, "(?i)a": None, "(?>a)": None, "*a": None, "a**": None, "[z-a]": None, "(": None, ")": None, "[a": None, "\\": None, "b{2}": ["bb"],
    "b{2,1}": None, "[]": [], "^[^]b": ["bb", "ab"], "^.b$": ["bb", "ab"], r"c\+\+": ["c++ [x]"], "a|B": ["a{,2}", "bb", "ab"], r"(b)\1": ["bb"], r"\2": None,
}


def test_patterns_for_the_running_engine(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p, want in CASES.items():
        java = java_pattern(p)
        if want is None:
            assert java is None, p
            with pytest.raises(ValueError):
                check_pattern(p)
        else:
            got = [r.t for r in df.filter(df.t.rlike("(?iu)" + java)).collect()]
            assert sorted(got) == sorted(want), p


@pytest.mark.parametrize("literal_max", [512, 2])
def test_a_bad_query_does_not_break_the_batch(spark, literal_max):
    listings = spark.createDataFrame([(t, None, "x") for t in TEXTS], "title string, company string, location string")
    log = spark.createDataFrame([(i, q) for i, q in enumerate([*CASES, "", None])], "request_id long, q string")
    got = {r.q: r.results for r in search_batch(listings, log, literal_max).collect()}
    assert got == {**{p: None if w is None else len(w) for p, w in CASES.items()}, "": len(TEXTS), None: None}
