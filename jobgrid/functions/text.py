"""Scalar column helpers.  All are Catalyst expressions, so
they stay inside whole-stage codegen; none calls Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
NA = "N/A"
NOT_DISCLOSED = "Not Disclosed"
CARD_NOT_DISCLOSED = "Not disclosed"
UNKNOWN_SOURCE = "Unknown"
DEFAULT_INITIAL = "J"
SOURCE_COLOURS = {
    "Internshala": "#22c55e",
    "Unstop": "#f97316",
    "Naukri": "#38bdf8",
    "Indeed": "#f472b6",
}
DEFAULT_COLOUR = "#6c63ff"

# Python's str.strip() whitespace: Unicode White_Space plus the four
# information separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{_WS}+|{_WS}+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``str.strip()``: Unicode whitespace from both ends.
    (Spark ``trim`` removes only U+0020.)"""
    return F.regexp_replace(_c(x), _STRIP_RE, "")


def strip_lower(x) -> Column:
    """``(x or "").strip().lower()``."""
    return F.lower(strip_ws(F.coalesce(_c(x), F.lit(""))))


def nonempty(x, default) -> Column:
    """JavaScript ``x || d`` / Python ``x or d`` for strings: null and '' default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)


def join_nonempty(parts: list, sep: str = ", ") -> Column:
    """Join the parts that are neither null nor empty."""
    arr = F.array(*[_c(p) for p in parts])
    return F.array_join(F.filter(arr, lambda v: v.isNotNull() & (v != "")), sep)


def strip_chars(x, chars: str) -> Column:
    """Python ``x.strip(chars)``: strip any of ``chars`` from both ends."""
    return F.btrim(_c(x), F.lit(chars))


def iso_date(x, default: str = NA) -> Column:
    """Part before ``T`` of a non-empty ISO string, else ``default``."""
    c = _c(x)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(F.substring_index(c, "T", 1))


def salary_text(min_sal, max_sal, period, currency) -> Column:
    """``CUR min - max / PERIOD`` / ``CUR min / PERIOD`` / ``Not Disclosed``.

    Arguments are strings already printed the way the source prints them;
    a value counts as absent when null, empty or zero.  A null period drops
    the ``/ PERIOD`` suffix (D14)."""
    lo, hi = _c(min_sal), _c(max_sal)

    def present(v):
        return v.isNotNull() & ~v.isin("", "0", "0.0")

    tail = F.when(_c(period).isNull(), F.lit("")).otherwise(F.concat(F.lit(" / "), _c(period)))
    cur = F.coalesce(_c(currency), F.lit("INR"))
    return (
        F.when(present(lo) & present(hi), F.concat(cur, F.lit(" "), lo, F.lit(" - "), hi, tail))
        .when(present(lo), F.concat(cur, F.lit(" "), lo, tail))
        .otherwise(F.lit(NOT_DISCLOSED))
    )


def snippet(x, n: int = 300, default: str = NA) -> Column:
    """First ``n`` characters plus ``...`` when non-empty, else ``default``."""
    c = _c(x)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(
        F.concat(F.substring(c, 1, n), F.lit("..."))
    )


def absolute_url(x, host: str) -> Column:
    """Prefix ``host`` when the link starts with ``/``."""
    c = _c(x)
    return F.when(c.startswith("/"), F.concat(F.lit(host), c)).otherwise(c)


def contains_ci(x, q) -> Column:
    """Case-insensitive literal substring; null never matches."""
    qq = q if isinstance(q, Column) else F.lit(q)
    return F.contains(F.lower(_c(x)), F.lower(qq))


def initial(x, default: str = DEFAULT_INITIAL) -> Column:
    """``(x || 'J')[0].toUpperCase()``."""
    return F.upper(F.left(nonempty(x, default), F.lit(1)))


def compact_count(n) -> Column:
    """``>= 1000`` → ``1.2K+`` (one decimal, half-up, trailing ``.0`` dropped)."""
    c = _c(n)
    k = F.round(c.cast("decimal(20,0)") / F.lit(1000).cast("decimal(20,0)"), 1).cast("decimal(21,1)")
    txt = F.regexp_replace(k.cast("string"), r"\.0$", "")
    return F.when(c >= 1000, F.concat(txt, F.lit("K+"))).otherwise(c.cast("string"))


def tag_list(x) -> Column:
    """Comma text → trimmed, non-empty items, order kept, no dedupe."""
    items = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda v: strip_ws(v))
    return F.filter(items, lambda v: v != "")


def skill_add(arr, skill) -> Column:
    """Append the trimmed skill if non-empty and not present (case-sensitive)."""
    s = strip_ws(_c(skill) if not isinstance(skill, str) else F.lit(skill))
    a = F.coalesce(_c(arr), F.array().cast("array<string>"))
    return F.when((s != "") & ~F.array_contains(a, s), F.array_append(a, s)).otherwise(a)


def skill_remove(arr, skill) -> Column:
    s = _c(skill) if not isinstance(skill, str) else F.lit(skill)
    return F.array_remove(F.coalesce(_c(arr), F.array().cast("array<string>")), s)


def array_text(arr, sep: str = ", ") -> Column:
    return F.array_join(F.coalesce(_c(arr), F.array().cast("array<string>")), sep)


def iso_millis(ts) -> Column:
    """JavaScript ``Date.toISOString()`` of a UTC timestamp."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def search_log_line(ts, query, results) -> Column:
    """``<ISO> SEARCH query="q" results=n``."""
    return F.format_string('%s SEARCH query="%s" results=%d', iso_millis(ts), _c(query), _c(results))


def valid_object_id(x) -> Column:
    """24 hexadecimal characters."""
    return F.coalesce(_c(x).rlike(r"^[0-9a-fA-F]{24}\z"), F.lit(False))
