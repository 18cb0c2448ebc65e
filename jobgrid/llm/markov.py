"""Smoothed variable-order Markov models of characters as DataFrames.

Strings come folded to a small alphabet, with ``order`` edge marks (``^``) in
front and one behind.  A table of grams (a symbol and the ``order`` symbols
before it) has at most ``symbols ** (order + 1)`` rows whatever the input, so it
may be broadcast.

A string of any length is first cut into pieces of ``PIECE`` symbols that
overlap by the order, so that the work is linear in its length and a row holds
the grams of one piece only.  Strings are known by two 64-bit hashes
(``key``): no gram carries its string along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: symbols of a piece; any number gives the same grams
PIECE = 256


def key(folded: Column) -> list[Column]:
    """Two 64-bit hashes that tell folded strings apart."""
    return [F.xxhash64(folded).alias("f1"), F.xxhash64(F.lit(7), folded).alias("f2")]


def between_marks(plain: Column, order: int) -> Column:
    return F.concat(F.lit("^" * order), plain, F.lit("^"))


def grams(strings: DataFrame, order: int, *carried: str) -> DataFrame:
    """(``carried`` columns, gram): every symbol of the column ``folded`` with
    the ``order`` symbols before it, a row each."""
    pieces = F.regexp_extract_all("folded", F.lit(f"(?s)(?=(.{{1,{PIECE + order}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = strings.select(*carried, F.explode(pieces).alias("piece")).filter(F.length("piece") > order)
    each = F.transform(F.sequence(F.lit(1), F.length("piece") - order), lambda i: F.substr("piece", i, F.lit(order + 1)))
    return cut.select(*carried, F.explode(each).alias("gram"))


def gram_counts(samples: DataFrame, order: int) -> DataFrame:
    """(gram, pos, neg) of samples (folded, pos, neg): how often each gram
    stands in strings of either class."""
    return grams(samples, order, "pos", "neg").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def log_ratio(counts: DataFrame, order: int, symbols: int) -> DataFrame:
    """(gram, lr): log of the last symbol's probability in the positive class
    less that in the negative one.  The estimate after a context is
    interpolated with that after the context less its first symbol, with the
    weight that Witten and Bell give to contexts followed by many kinds."""
    lower = None
    for n in range(1, order + 2):  # symbols in the gram; the context has n - 1
        level = counts.groupBy(F.right("gram", F.lit(n)).alias("g")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        if lower is not None:
            level = level.join(lower, F.right("g", F.lit(n - 1)) == F.col("shorter"))
        context = W.partitionBy(F.left("g", F.lit(n - 1)))
        p = {}
        for c in ("pos", "neg"):
            seen, kinds = F.sum(c).over(context), F.count_if(F.col(c) > 0).over(context)
            if lower is None:
                p[c] = (F.col(c) + 1) / (seen + symbols)
            else:
                p[c] = F.when(seen > 0, (F.col(c) + kinds * F.col(f"p_{c}")) / (seen + kinds)).otherwise(F.col(f"p_{c}"))
        lower = level.select(F.col("g").alias("shorter"), p["pos"].alias("p_pos"), p["neg"].alias("p_neg"))
    return lower.select(F.col("shorter").alias("gram"), F.log(F.col("p_pos") / F.col("p_neg")).alias("lr"))


def scores(strings: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(f1, f2, score) of each distinct folded string: mean log ratio a symbol.
    ``model`` has every gram of the strings and is small by its alphabet."""
    distinct = strings.select("folded").distinct().select(*key(F.col("folded")), "folded")
    return (
        grams(distinct, order, "f1", "f2")
        .join(F.broadcast(model), "gram")
        .groupBy("f1", "f2").agg(F.avg("lr").alias("score"))
    )
