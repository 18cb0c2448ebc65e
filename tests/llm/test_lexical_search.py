"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from jobgrid.llm import lexical_search as ls
from jobgrid.llm import queries as q
from tests.llm import brute
from tests.llm.conftest import SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.SMALL))


def ranked(docs, items, k=50):
    """docs: (id, text); items: (id, text)"""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if there else None, -s) for r, (s, there, i) in enumerate(sorted(scores)[:k])]
    return out


def test_terms():
    text = "".join(map(chr, range(0x250))) + "日本語 a_b C++ don't 4x4 İ ſ K"
    assert [t.decode() for t in ls.terms(text.encode())] == terms(text)


def test_query(spark, hard, written, tmp_path):
    texts = ["alpha1 Beta2 gamma,3 delta.4 épsilon5 zeta6", None, "", "nowhere", "the MIT license", "x y same line " * 40, hard[0][45][1], hard[0][45][1], "日本語 のテキスト"]
    items = [(i // 2, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")]
    spark.createDataFrame(items, "item_id long, text string, rank string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, asked = spark.read.parquet(f"{written}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    want = ranked([r[:2] for r in hard[0]], [i[:2] for i in items])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for block, segment in ((1000, 1 << 24), (2, 300)):  # several blocks of items, many segments
        got = ls.search(docs, asked, block=block, segment=segment).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert got[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}


def test_no_items_or_no_documents(spark, empty, tmp_path):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a c"), (2, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], SCHEMA)
    assert ls.search(docs, none).collect() == [] and ls.search(nothing, one).collect() == []
    assert [tuple(r) for r in ls.search(docs, one).collect()] == ranked([(1, "a c"), (2, None)], [(1, "a b")])


lists = st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=40), max_size=6)


@settings(max_examples=200, deadline=None)
@given(lists, st.integers(1, 12), st.integers(1, 4))
def test_nra_is_exact(given_lists, k, first_read):
    held, score = [], np.zeros(31, np.int64)
    for x in given_lists:
        post = sorted(dict(x).items(), key=lambda p: (-p[1], p[0]))
        docs, worth = np.array([p[0] for p in post], np.int32), np.array([p[1] for p in post], np.int64)
        held.append((docs, worth))
        np.add.at(score, docs, worth)
    found, got = ls.nra(held, 31, k, 0, first_read)
    assert (got == score[found]).all()
    bar = max(1, sorted(score)[-k])
    assert set(np.flatnonzero(score >= bar)) <= set(found.tolist())
