"""Listing filters and searches.

An empty parameter means "no filter" (JavaScript truthiness).  User text is a
regular expression in ``mode='regex'`` (validated on the driver first, D8) or
a literal substring in ``mode='literal'``.  Regex matching is case-insensitive
and Unicode-aware (``(?iu)``); a null field never matches.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.functions.text import contains_ci


_COUNT = re.compile(r"\{\d+(,\d*)?\}")
_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!|<[A-Za-z][A-Za-z0-9]*>)")
_SAME_ESCAPES = "dDwWsSbBtnrf0"
_HEX = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})")


def _escape(p: str, i: int, groups: int) -> tuple[str, int] | None:
    """The escape at ``i`` for Java, and its length."""
    if i + 1 == len(p):
        return None
    if m := _HEX.match(p, i):
        return m[0], len(m[0])
    c = p[i + 1]
    if c in _SAME_ESCAPES:
        return "\\" + c, 2
    if c == "v":
        return r"\x0B", 2
    if c.isdigit():
        return ("\\" + c, 2) if int(c) <= groups else None
    return (c if c.isalpha() else "\\" + c), 2  # any other letter stands for itself


def _class(p: str, i: int, groups: int) -> tuple[str, int] | None:
    """The character class at ``i`` for Java, and its length."""
    j = i + 1
    out = "["
    if p[j : j + 1] == "^":
        out, j = "[^", j + 1
    if p[j : j + 1] == "]":
        return ("(?!)" if out == "[" else r"[\s\S]"), j + 1 - i
    while j < len(p) and p[j] != "]":
        if p[j] == "\\":
            got = (r"\x08", 2) if p[j + 1 : j + 2] == "b" else _escape(p, j, groups)
            if got is None:
                return None
            out, j = out + got[0], j + got[1]
        else:
            out, j = out + ("\\" + p[j] if p[j] in "[&~^" else p[j]), j + 1
    if j == len(p):
        return None
    try:
        re.compile(out + "]")  # ranges in order
    except re.error:
        return None
    return out + "]", j + 1 - i


def java_pattern(p: str) -> str | None:
    """A JavaScript pattern (no ``u`` flag) written for Java's engine, null if
    JavaScript rejects it.  The same text can mean different things to the two:
    ``[[]``, ``a{,2}`` and ``\\p`` are literal there, ``c++`` is an error, ``$``
    is only the very end."""
    groups = len(re.findall(r"(?<!\\)\((?!\?[^<]|\?<[=!])", p))
    out: list[str] = []
    i = depth = 0
    repeatable = False
    while i < len(p):
        c = p[i]
        size, was, repeatable = 1, repeatable, True
        if c in "\\[":
            got = _escape(p, i, groups) if c == "\\" else _class(p, i, groups)
            if got is None:
                return None
            piece, size = got
            repeatable = piece not in (r"\b", r"\B")
        elif c in "*+?" or (c == "{" and _COUNT.match(p, i)):
            piece = _COUNT.match(p, i)[0] if c == "{" else c
            if not was:
                return None
            if c == "{" and "," in piece[:-2] and int(piece[1:-1].split(",")[0]) > int(piece[1:-1].split(",")[1]):
                return None
            size = len(piece)
            if p[i + size : i + size + 1] == "?":
                piece, size = piece + "?", size + 1
            repeatable = False
        elif c == "(":
            m = _GROUP.match(p, i)
            if m is None and p[i + 1 : i + 2] == "?":
                return None
            piece = m[0] if m else "("
            size, depth, repeatable = len(piece), depth + 1, False
        elif c == ")":
            piece, depth = ")", depth - 1
            if depth < 0:
                return None
        elif c in "^|$":
            piece, repeatable = (r"\z" if c == "$" else c), False
        elif c == ".":
            piece = r"[^\n\r\u2028\u2029]"
        else:
            piece = "\\" + c if c in "{}]" else c
        out.append(piece)
        i += size
    return None if depth else "".join(out)


def check_pattern(p: str) -> str:
    """The pattern for the engine that runs it; a malformed one is rejected
    before any job runs (D8)."""
    java = java_pattern(p)
    if java is None:
        raise ValueError(f"invalid search pattern {p!r}")
    return java


def matches(col: str | Column, q: str, mode: str = "regex") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if mode == "literal":
        return contains_ci(c, q)
    if mode != "regex":
        raise ValueError(f"mode must be 'regex' or 'literal', not {mode!r}")
    return c.rlike("(?iu)" + check_pattern(q))


def _any(preds: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, preds), F.lit(False))


def source_pred(source: str | None) -> Column | None:
    if not source or source == "all":
        return None
    return F.col("source") == source


def location_pred(location: str | None, mode: str = "regex") -> Column | None:
    return matches("location", location, mode) if location else None


def type_pred(type_: str | None) -> Column | None:
    return (F.col("type") == type_) if type_ else None


def title_company_pred(search: str | None, mode: str = "regex") -> Column | None:
    if not search:
        return None
    return _any([matches("title", search, mode), matches("company", search, mode)])


def list_predicate(source=None, location=None, type=None, search=None, mode="regex") -> Column:
    preds = [
        p
        for p in (
            source_pred(source),
            location_pred(location, mode),
            type_pred(type),
            title_company_pred(search, mode),
        )
        if p is not None
    ]
    # a null predicate drops the row, as false does: no coalesce, so plain
    # comparisons stay pushable to the scan
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def with_type(df: DataFrame) -> DataFrame:
    """No source writes ``type``; it is a nullable column of the listing."""
    return df if "type" in df.columns else df.withColumn("type", F.lit(None).cast("string"))


def list_filtered(df: DataFrame, source=None, location=None, type=None, search=None, mode="regex") -> DataFrame:
    """AND of whichever of the four filters are given."""
    if type:
        df = with_type(df)
    return df.filter(list_predicate(source, location, type, search, mode))


def search(df: DataFrame, q: str | None, mode: str = "regex") -> DataFrame:
    """Regex on title OR company OR location; empty query = all rows."""
    if not q:
        return df
    return df.filter(_any([matches(c, q, mode) for c in ("title", "company", "location")]))


def saved_view_filter(df: DataFrame, location=None, type=None, search=None) -> DataFrame:
    """Client-side filter of a user's saved jobs: location regex, ``type = t OR
    duration = t``, literal lower-cased substring on title or company."""
    preds = []
    if location:
        preds.append(matches("location", location, "regex"))
    if type:
        df = with_type(df)
        preds.append(_any([F.col("type") == type, F.col("duration") == type]))
    if search:
        preds.append(_any([contains_ci("title", search), contains_ci("company", search)]))
    return df.filter(reduce(lambda a, b: a & b, preds, F.lit(True)))


def saved_page_search(df: DataFrame, q: str | None) -> DataFrame:
    """Literal substring on title or company of the saved page; rows whose
    title and company are both null or empty drop even for an empty query."""
    q = (q or "").lower()

    def hit(c):
        return (F.col(c) != "") & F.contains(F.lower(F.col(c)), F.lit(q))

    return df.filter(_any([hit("title"), hit("company")]))
