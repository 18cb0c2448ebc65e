"""Host-level quality rules.

Method.  Every document is measured against a few rules.  Failures are summed
by host (the ``source`` column); each rule's failure rate on a host is shrunk
towards the corpus by a beta prior whose two parameters are fitted to all
hosts by the method of moments.  A host whose shrunk rate passes ``max_rate``
for any rule is rejected, and the verdict is joined back to its documents.

Scale.  The measures are one projection without a shuffle; they are written
once, so no text is measured twice.  Host sums use a map-side partial
aggregate, so a host with a third of all rows costs one row per task.  Only
rejected hosts are joined back, broadcast after they have been counted.
DataFrame functions only.

Defined cases.  A null text has no words (and so fails ``short``).  Documents
with a null host are judged by their own measures only.  Repeated rows are
measured, counted and returned each.  Windows of three words are compared by a
64-bit hash of the words within one document.  Input columns pass through
``judge`` under their names; the measures sit in one struct column whose name
avoids them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.llm.frames import WORD, broadcast_if_small, free_name, store, text_of

RULES = ("short", "repeated", "symbols", "dup_lines", "word_length")
#: strength of the prior when hosts do not differ more than chance allows
STRONGEST = 1e6


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(ordered: Column) -> Column:
    """Starts of the windows found twice or more, from (hash, start) in order."""
    h = lambda j: F.get(ordered, j)["h"]
    twice = F.filter(ordered, lambda x, j: F.coalesce(x["h"] == h(j - 1), F.lit(False)) | F.coalesce(x["h"] == h(j + 1), F.lit(False)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words covered by windows of three words at the ordered ``starts``."""
    steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def measure(docs: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long)."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    t, w, h, o, s = (free_name(docs, f"{out}_{x}") for x in "twhos")
    c = F.col
    lines = F.filter(F.split(c(t), "\n"), lambda x: x.rlike(WORD))
    got = docs.select(*cols, text_of(text_col).alias(t))
    got = got.select(*cols, t, _words(c(t)).alias(w))
    got = got.select(*cols, t, w, _window_hashes(c(w)).alias(h), lines.alias(f"{t}l"))
    repeats = F.size(F.array_distinct(c(h))) < F.size(c(h))
    pairs = F.transform(c(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    got = got.select(*cols, t, w, f"{t}l", F.when(repeats, F.sort_array(pairs)).alias(o))
    got = got.select(*cols, t, w, f"{t}l", F.when(c(o).isNotNull(), _repeated_starts(c(o))).alias(s))
    return got.select(
        *cols,
        F.struct(
            F.size(c(w)).cast("long").alias("n_words"),
            F.length(F.array_join(c(w), "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all(c(t), F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
            (F.size(c(f"{t}l")) - F.size(F.array_distinct(c(f"{t}l")))).cast("long").alias("n_dup_lines"),
            F.coalesce(_covered(c(s)), F.lit(0).cast("long")).alias("n_repeat_words"),
            F.size(c(f"{t}l")).cast("long").alias("n_lines"),
        ).alias(out),
    )


def failures(m: str) -> dict[str, Column]:
    """Each rule's failure as a condition on the struct column ``m``."""
    f = lambda x: F.col(f"{m}.{x}")
    return {
        "short": f("n_words") < 50,
        "repeated": 100 * f("n_repeat_words") > 50 * f("n_words"),
        "symbols": 10 * f("n_symbols") > f("n_words"),
        "dup_lines": 10 * f("n_dup_lines") > 3 * f("n_lines"),
        "word_length": (f("word_chars") < 3 * f("n_words")) | (f("word_chars") > 12 * f("n_words")),
    }


def host_table(measured: DataFrame, host: str, m: str, max_rate: float = 0.5) -> DataFrame:
    """(host, n, fail_*, rate_*, rejected) of every host; ``rate_*`` is the
    posterior mean of the host's failure rate."""
    flags = failures(m)
    hosts = measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(flags[r]).alias(f"fail_{r}") for r in RULES)
    )
    hosts = store(hosts, "quality-hosts")
    stats = hosts.agg(
        F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("inv_n"),
        *(F.sum(f"fail_{r}").alias(f"sum_{r}") for r in RULES),
        *(F.var_pop(F.col(f"fail_{r}") / F.col("n")).alias(f"var_{r}") for r in RULES),
    ).first()
    for r in RULES:
        mean = (stats[f"sum_{r}"] or 0) / stats["n"] if stats["n"] else 0.0
        spread = (stats[f"var_{r}"] or 0.0) - mean * (1 - mean) * (stats["inv_n"] or 0.0)  # less chance
        strength = min(STRONGEST, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else STRONGEST
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + mean * strength) / (F.col("n") + strength))
    return hosts.withColumn("rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > max_rate)


def judge(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, columns: list[str] | None = None
) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` (default: all; the host column always) with a
    struct column of the measures, base_failed and kept; and that column's
    name.  Measured once: the rows are kept in the shared folder before the
    host verdicts are joined back."""
    m = free_name(docs, "quality")
    columns = docs.columns if columns is None else list(dict.fromkeys([*columns, host_col]))
    measured = store(measure(docs, text_col, m).select(*(F.col(f"`{c}`") for c in columns), m), "quality")
    bad = host_table(measured, host_col, m, max_rate).filter("rejected")
    key, mark = free_name(measured, "bad_host"), free_name(measured, "host_rejected")
    bad = broadcast_if_small(bad.select(F.col("host").alias(key), F.lit(True).alias(mark)))
    joined = measured.join(bad, F.col(host_col) == F.col(key), "left")
    flags = failures(m)
    base = flags["short"] | flags["repeated"]
    kept = ~base & F.col(mark).isNull()
    cols = [F.col(f"`{c}`") for c in columns]
    return joined.select(*cols, F.struct(f"{m}.*", base.alias("base_failed"), kept.alias("kept")).alias(m)), m


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    judged, m = judge(docs, text_col, host_col, max_rate)
    return judged.filter(F.col(f"{m}.kept")).drop(m)
