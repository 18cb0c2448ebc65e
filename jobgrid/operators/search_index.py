"""Batch search: each logged query → its number of hits.

Queries are regular expressions, so a listing can match any of them; comparing
every query with every listing costs their product.  Instead:

* listings are cut to their distinct field texts, with how many listings have
  each, and these to distinct values (a title, a company or a place stands in
  many): patterns meet values, never listings;
* every query is read for the literal strings that a match must hold (``factors``:
  for each way the pattern can match, one run of plain characters); a value
  that has none of the query's factor trigrams cannot match it;
* the distinct values are indexed by trigram, queries meet them by an equi-join on
  the rarest trigrams of their factors, and the regular expression only verifies
  what is left.  A trigram that very many values hold is a hot key of that join,
  and AQE splits it;
* a query without a factor of three characters (``.*``, ``a|b``, ``c+``) can match
  any text: it is *open*, and is verified against the distinct values, in blocks
  of queries dealt over the cluster, because its answer may be all of them;
* the queries that match a value become lists of numbers, cut to blocks of at most
  about ``BLOCK`` queries; a text takes the lists of its fields, and counts once for
  each query in any of them, in the task that holds it: only partial counts travel.

One path serves every number of queries; two numbers come to the driver.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrid.operators.filters import java_pattern
from jobgrid.session import cut_lineage

FIELDS = ("title", "company", "location")
GRAM = 3
#: alternatives that a pattern is read into; with more it is open
MOST_FACTORS = 64
#: queries in a list of those that match a value
BLOCK = 10_000


# ---- factors of a pattern -----------------------------------------------------------


_QUANTIFIER = re.compile(r"\*|\+|\?|\{(\d+)(?:,(\d*))?\}")
_CLASS_ESCAPES = "dDwWsSbB"


#: characters beyond ASCII that a case-blind match takes for ASCII letters, and these
FOLDED = ("\u017f\u0131\u0130\u212a", "siik")


def _fold(c: str) -> str | None:
    """A plain ASCII character in small letters; others end a run."""
    return c.lower() if c.isascii() else None


class _Reader:
    """Alternatives of a pattern as lists of literal runs; a run ends where
    something else than one fixed character stands."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def alternatives(self) -> list[list[str]]:
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return [seq for group in out for seq in group]

    def sequence(self) -> list[list[str]]:
        """All ways through a sequence, each a list of runs; the last run of a
        way is open, so that what follows can lengthen it."""
        ways: list[list[str]] = [[""]]
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            ways = self.joined(ways, self.atom())
            if len(ways) > MOST_FACTORS:
                raise OverflowError
        return ways

    @staticmethod
    def joined(ways: list[list[str]], piece) -> list[list[str]]:
        if piece is None:  # anything, or nothing: the runs end here
            return [[*w, ""] for w in ways]
        return [[*w[:-1], w[-1] + p[0], *p[1:]] for w in ways for p in piece]

    def atom(self):
        """Ways through one atom with its quantifier; None if it fixes nothing."""
        p, c = self.p, self.p[self.i]
        self.i += 1
        piece = None
        if c == "(":
            look = re.match(r"\?(?::|=|!|<=|<!|<[A-Za-z][A-Za-z0-9]*>)", p[self.i :])
            kind = look[0] if look else ""
            self.i += len(kind)
            inside = self.alternatives()
            self.i += 1  # the closing bracket
            # what is looked at is not consumed: it fixes nothing where it stands
            piece = None if kind in ("?=", "?!", "?<=", "?<!") else inside
        elif c == "[":
            if p[self.i : self.i + 1] == "^":
                self.i += 1
            while p[self.i] != "]":
                self.i += 2 if p[self.i] == "\\" else 1
            self.i += 1
        elif c == "\\":
            e = p[self.i]
            self.i += 1
            hexed = re.match(r"x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})", p[self.i - 1 :])
            if hexed:
                self.i += len(hexed[0]) - 1
            elif not e.isalnum() and (f := _fold(e)) is not None:
                piece = [[f]]
        elif c in "^$":
            return [[""]]  # a place, not a character
        elif c != "." and (f := _fold(c)) is not None:
            piece = [[f]]
        if m := _QUANTIFIER.match(p, self.i):
            self.i = m.end()
            least = {"*": 0, "?": 0, "+": 1}.get(m[0], int(m[1] or 0) if m[1] else 0)
            if p[self.i : self.i + 1] == "?":
                self.i += 1
            if least == 0 or piece is None:
                return None
            if m[0] != "{1}":  # at least once: the piece stands, but what is beside it is not known
                return [[*w, ""] for w in piece]
        return piece


def factors(pattern: str) -> list[str] | None:
    """For a valid pattern: literals, in small letters, of which every match
    holds at least one; None if there are none of ``GRAM`` characters."""
    try:
        ways = _Reader(pattern).alternatives()
    except (OverflowError, IndexError, RecursionError):
        return None
    best = {max(runs, key=len) for runs in ways}
    return sorted(best) if best and min(map(len, best)) >= GRAM and len(best) <= MOST_FACTORS else None


_QUERY = T.StructType([
    T.StructField("q", T.StringType()), T.StructField("java", T.StringType()),
    T.StructField("factors", T.ArrayType(T.StringType())),
])


def read_queries(qs: DataFrame) -> DataFrame:
    """(q, java, factors) of each distinct query: the pattern for the engine
    that runs it (null: malformed) and its factors (null: open).  Python sees
    each distinct query once and never a listing."""

    def run(frames):
        for frame in frames:
            rows = []
            for q in frame["q"]:
                java = java_pattern(q)
                rows.append((q, java, factors(q) if java is not None else None))
            yield pd.DataFrame(rows, columns=_QUERY.fieldNames())

    return qs.select("q").filter(F.col("q").isNotNull()).distinct().mapInPandas(run, _QUERY)


# ---- the index and the search --------------------------------------------------------


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    cut = F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def field_texts(listings: DataFrame) -> DataFrame:
    """(title, company, location, n): distinct field texts and how many
    listings have them."""
    return listings.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n"))


def field_values(texts: DataFrame) -> DataFrame:
    """(value): the distinct values of all fields."""
    return texts.select(F.explode(F.array_distinct(F.array(*FIELDS))).alias("value")).filter("value IS NOT NULL").distinct()


def gram_index(values: DataFrame) -> DataFrame:
    """(gram, value): the trigrams of each value, in small letters."""
    held = _grams(F.lower(F.translate(F.col("value"), *FOLDED)))
    return values.select("value", F.explode(held).alias("gram"))


def candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q, value) of the values that hold the rarest trigram of one of the
    query's factors."""
    wanted = queries.select("q", F.explode("factors").alias("factor")).select("q", "factor", F.explode(_grams(F.col("factor"))).alias("gram"))
    near = index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    held = near.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("q", "factor").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    # a trigram that no text holds rules its factor out
    probe = wanted.join(held, "gram", "left").withColumn("_rn", rarest).filter("_rn = 1 AND df > 0")
    return probe.select("q", "gram").distinct().join(near, "gram").select("q", "value").distinct()


def _verified(pairs: DataFrame) -> DataFrame:
    """(no, value) of the pairs (no, java, value) that match."""
    return pairs.filter(F.rlike("value", F.concat(F.lit("(?iu)"), F.col("java")))).select("no", "value")


def value_matches(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(no, value): the values that each query (no, q, java, factors) matches."""
    closed = queries.filter("factors IS NOT NULL")
    near = candidates(closed, gram_index(values)).join(closed.select("q", "no", "java"), "q")
    # open queries go to every shard of the values; a shard's pairs are streamed, query by query, into the filter
    shards = F.lit(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wide = queries.filter("factors IS NULL AND java IS NOT NULL AND q <> ''")
    wide = wide.select("no", "java", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    dealt = values.withColumn("shard", F.pmod(F.xxhash64("value"), shards).cast("int"))
    return _verified(near).unionByName(_verified(wide.hint("merge").join(dealt, "shard")))


def text_hits(texts: DataFrame, matches: DataFrame, block: int = BLOCK) -> DataFrame:
    """(no, results): listings with a field that the query matches."""
    most = matches.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = F.lit(int(most) // int(block) + 1)
    lists = matches.groupBy("value", F.pmod(F.xxhash64("no"), blocks).cast("int").alias("block")).agg(F.collect_list("no").alias("nos"))
    held = texts.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    for c in FIELDS:
        held = held.join(lists.select(F.col("value").alias(c), "block", F.col("nos").alias(f"_{c}")), [c, "block"], "left")
    none = F.array().cast("array<bigint>")
    every = F.array_distinct(F.concat(*(F.coalesce(f"_{c}", none) for c in FIELDS)))
    return held.select(F.explode(every).alias("no"), "n").groupBy("no").agg(F.sum("n").alias("results"))


def query_hits(listings: DataFrame, qs: DataFrame) -> DataFrame:
    """(q, results) for each distinct ``q``; empty q counts all rows; an
    invalid pattern gives a null count (the endpoint's error)."""
    queries = cut_lineage(read_queries(qs).withColumn("no", F.monotonically_increasing_id()), "search-queries")
    texts = cut_lineage(field_texts(listings), "search-texts")
    matches = cut_lineage(value_matches(queries, field_values(texts)), "search-matches")
    hits = text_hits(texts, matches)
    total = listings.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = queries.select("q", "java", "no").join(hits, "no", "left")
    results = F.when(F.col("q") == "", total).when(F.col("java").isNotNull(), F.coalesce("results", F.lit(0)))
    return found.select("q", results.cast("bigint").alias("results"))


def search_batch(listings: DataFrame, log: DataFrame) -> DataFrame:
    """(request_id, q, results) for every logged search; a null query has no
    count."""
    return log.select("request_id", "q").join(query_hits(listings, log), "q", "left").select("request_id", "q", "results")
