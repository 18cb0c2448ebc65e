"""Golden cases for the scalar column helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobgrid.functions import text as fn


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value,expected",
    [(None, ""), ("  Foo ", "foo"), ("\tBar\n", "bar"), (" Baz ", "baz"), ("\x1cQ\x1f", "q")],
)
def test_strip_lower_is_python_strip(spark, value, expected):
    assert one(spark, fn.strip_lower("x"), value) == expected
    assert (value or "").strip().lower() == expected


@pytest.mark.parametrize("value,expected", [(None, "d"), ("", "d"), (" ", " "), ("a", "a")])
def test_nonempty(spark, value, expected):
    assert one(spark, fn.nonempty("x", "d"), value) == expected


@pytest.mark.parametrize(
    "n,expected",
    [(999, "999"), (1000, "1K+"), (1049, "1K+"), (1050, "1.1K+"), (1950, "2K+"), (12345, "12.3K+"), (0, "0")],
)
def test_compact_count_half_up(spark, n, expected):
    assert one(spark, fn.compact_count("x"), n, "x long") == expected


def test_tag_list_keeps_order_and_repeats(spark):
    got = one(spark, fn.tag_list("x"), " a , sql,, b,sql,  ")
    assert got == ["a", "sql", "b", "sql"]
    assert one(spark, fn.tag_list("x"), None) == []


def test_skill_add_remove(spark):
    df = spark.createDataFrame([(["a", "b"],)], "s array<string>")
    r = df.select(
        fn.skill_add("s", " c ").alias("add"),
        fn.skill_add("s", "a").alias("dup"),
        fn.skill_add("s", "   ").alias("blank"),
        fn.skill_remove("s", "a").alias("rm"),
        fn.array_text("s").alias("txt"),
    ).first()
    assert r["add"] == ["a", "b", "c"] and r["dup"] == ["a", "b"] and r["blank"] == ["a", "b"]
    assert r["rm"] == ["b"] and r["txt"] == "a, b"


@pytest.mark.parametrize(
    "lo,hi,per,cur,expected",
    [
        ("100", "200", "YEAR", None, "INR 100 - 200 / YEAR"),
        ("100", None, "MONTH", "USD", "USD 100 / MONTH"),
        ("0", "200", "YEAR", None, "Not Disclosed"),
        (None, "200", "YEAR", None, "Not Disclosed"),
        ("100", "200", None, None, "INR 100 - 200"),
    ],
)
def test_salary_text(spark, lo, hi, per, cur, expected):
    df = spark.createDataFrame([(lo, hi, per, cur)], "lo string, hi string, per string, cur string")
    assert df.select(fn.salary_text("lo", "hi", "per", "cur")).first()[0] == expected


def test_snippet_counts_characters(spark):
    s = "é" * 400
    assert one(spark, fn.snippet("x"), s) == "é" * 300 + "..."
    assert one(spark, fn.snippet("x"), "") == "N/A"
    assert one(spark, fn.snippet("x"), None) == "N/A"


def test_iso_date_and_absolute_url(spark):
    assert one(spark, fn.iso_date("x"), "2024-05-01T10:00:00Z") == "2024-05-01"
    assert one(spark, fn.iso_date("x"), "") == "N/A"
    assert one(spark, fn.absolute_url("x", "https://h"), "/a") == "https://h/a"
    assert one(spark, fn.absolute_url("x", "https://h"), "https://o/a") == "https://o/a"


def test_strip_chars_is_a_character_set(spark):
    assert one(spark, fn.strip_chars("x", ", "), ", , Delhi, , ") == "Delhi"
    assert ", , Delhi, , ".strip(", ") == "Delhi"


def test_initial_and_contains(spark):
    assert one(spark, fn.initial("x"), None) == "J"
    assert one(spark, fn.initial("x"), "acme") == "A"
    assert one(spark, fn.contains_ci("x", "GEAR"), "Hot gear") is True
    assert one(spark, fn.contains_ci("x", "GEAR"), None) is None


def test_valid_object_id(spark):
    ok = "0123456789abcdefABCDEF01"
    assert one(spark, fn.valid_object_id("x"), ok) is True
    assert one(spark, fn.valid_object_id("x"), ok[:-1]) is False
    assert one(spark, fn.valid_object_id("x"), None) is False


def test_search_log_line(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.678901", "red", 7)], "ts string, q string, n long")
    df = df.withColumn("ts", F.to_timestamp_ntz("ts"))
    line = df.select(fn.search_log_line("ts", "q", "n")).first()[0]
    assert line == '2024-01-02T03:04:05.678Z SEARCH query="red" results=7'
