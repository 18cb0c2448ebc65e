"""URL filter: explicit host/path rules first, a character language-model ratio
for the rest.

Method.  URLs that a rule decides are the labelled rows.  From them two
smoothed variable-order Markov models are built, one for accepted and one for
rejected URLs: the probability of a symbol after its last three symbols is
interpolated (Witten-Bell) with the estimate after two, one and no symbols.  A
URL's score is the mean log-likelihood difference per symbol.  A fifth of the
labelled URLs is held out; the threshold is the score that keeps
``1 - false_reject`` of the held-out accepted ones.

Scale.  Symbols are folded to 32 classes, so a table of 4-grams has at most
32**4 rows whatever the input: it is counted with a map-side partial aggregate
and may be broadcast.  Scoring works on distinct URLs; nothing else is
shuffled.  DataFrame functions only.

Defined cases.  A null URL, or one without ``://``, has empty host and path, no
rule, and is scored as an empty string.  Without accepted or without rejected
labelled rows there is no ratio, and without held-out accepted ones no threshold;
undecided URLs are then allowed.  A URL of any length is read in time linear in
it.  Repeated rows
are judged alike and all returned.  Of the input only the id and URL columns
are used, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.llm import markov
from jobgrid.llm.frames import store

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: letters, one class each for digits, '/', '.', '-' and '_', anything else, and the edge mark
SYMBOLS = 32
ORDER = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, its verdict) of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def fold(url: Column) -> Column:
    """The URL without scheme in the 32 symbols, between edge marks."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)).otherwise(url), F.lit(""))
    plain = F.translate(rest, UPPER + "0123456789_", LOWER + "0" * 10 + "-")
    return markov.between_marks(F.regexp_replace(plain, r"[^a-z0/.\-]", "~"), ORDER)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, false_reject: float = 0.05, holdout: int = 5
) -> DataFrame:
    """``id_col``, host, path, rule, verdict (allow or block) and score (null
    where a rule decides) of every row.  ``false_reject``: the share of held-out
    accepted URLs that the threshold may reject; ``holdout``: one labelled URL
    in so many is held out."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), fold(url).alias("folded"))
    rows = rows.select("*", *markov.key(F.col("folded")))
    name, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "decided": decided, "held": F.pmod(F.xxhash64("folded"), F.lit(holdout)) == 0})
    train = rows.groupBy("folded").agg(*(F.count_if(~F.col("held") & (F.col("decided") == v)).alias(c) for v, c in (("allow", "pos"), ("block", "neg"))))
    counts = store(markov.gram_counts(train, ORDER), "url-grams")
    model = store(markov.log_ratio(counts, ORDER, SYMBOLS), "url-model")
    scored = store(markov.scores(rows, model, ORDER), "url-scores")
    classes = counts.agg(F.sum("pos"), F.sum("neg")).first()
    cut = (
        rows.filter("held and decided = 'allow'").join(scored, ["f1", "f2"])
        .agg(F.percentile_approx("score", false_reject, 10000)).first()[0]
        if classes[0] and classes[1] else None
    )
    judged = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return rows.join(scored, ["f1", "f2"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )
