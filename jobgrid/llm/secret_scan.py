"""Secret scan: fixed patterns, and character Markov models for the rest.

Method.  Three fixed patterns give the base spans.  They are blanked, and in what
is left every run of ``LEAST`` identifier characters or more is judged by two Markov models, of random strings and
of ordinary identifiers, through the mean log-likelihood ratio a character.
Labelled samples come from the corpus: the values of the base spans, and a
hash of each ordinary sample written in base 64, are random strings; runs of
letters outside all base spans are ordinary identifiers.  A fifth of the
ordinary ones is held out; the threshold lets ``false_alarm`` of them pass, and
is zero at least.

Scale.  One pass over the texts leaves a small table of runs and the lengths
between them; offsets are running sums within a document.  Samples are counted
once each, the gram tables are bounded by the alphabet, and only spans are
shuffled.  DataFrame functions only.

Defined cases.  A null text is empty.  Rows are told apart by a row number, so
null or repeated ids do not mix.  Without samples of one class the method adds
nothing.  A run that touches a base span is judged by what lies outside it; a
run of any length is one span, read in linear time.  Runs under ``LEAST``
characters are not judged.  Offsets are code points, ends exclusive.  Of the input only the id
and text columns are used; ``redact`` returns all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrid.llm import markov
from jobgrid.llm.frames import free_name, store, text_of

#: kinds in the order in which they are listed; patterns are fixed values
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: characters of the shortest assigned value
VALUE = 6
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: characters of the shortest run that the models judge
LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "random")
ORDER, SYMBOLS = 2, 55


def _hits(text: Column, pattern: str, group: int, when: Column | None = None) -> Column:
    """Array of (gap, hit, value): the characters before a match and after the
    one before it, the match, its group."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    kept = F.filter(found, lambda x: x["hit"].isNotNull())  # the rest after the last match goes
    return kept if when is None else F.when(when, kept).otherwise(F.slice(kept, 1, 0))


def _blanked(text: Column) -> Column:
    """The text with its base spans as blanks, as long as before.  Where spans
    of two kinds cross, the one that begins first is blanked, of the other what
    is left may stand; ``_spans`` drops runs inside a base span."""
    pattern = f"{ASSIGN}|{ACCESS}|{HEX}"
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"),
    )

    def shown(x):
        dropped = F.length(x["value"]).between(1, VALUE - 1)  # an assignment too short for a base span stays
        return F.concat(x["gap"], F.coalesce(F.when(dropped, x["hit"]).otherwise(F.repeat(F.lit(" "), F.length(x["hit"]))), F.lit("")))

    return F.array_join(F.transform(parts, shown), "")


def _fold(value: Column) -> Column:
    """Letters as they are, digits as 0, other characters as one symbol."""
    return markov.between_marks(F.regexp_replace(F.translate(value, "123456789", "0" * 9), r"[^A-Za-z0]", "-"), ORDER)


def scan_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, ``id_col``, assign, access, hex, random): each kind's matches."""
    text = F.col("secret_text")
    lower = F.lower(text)
    named = lower.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        named = named | lower.contains(k)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("secret_text"))
    based = rows.select(
        "row", "id", "secret_text",
        _hits(text, ASSIGN, 2, named & text.rlike("[:=]")).alias("assign"),
        _hits(text, ACCESS, 0, text.contains("AKIA")).alias("access"),
        _hits(text, HEX, 0).alias("hex"),
    )
    some = (F.size("assign") > 0) | (F.size("access") > 0) | (F.size("hex") > 0)
    based = based.withColumn("secret_text", F.when(some, _blanked(text)).otherwise(text))
    return based.select("row", "id", "assign", "access", "hex", _hits(text, RUN, 0).alias("random"))


def _spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of the base spans, and of the runs (kind
    3) beside them."""
    every = None
    for number, kind in enumerate(KINDS):
        hits = scanned.filter(F.size(kind) > 0).select("row", F.lit(number).alias("kind"), F.posexplode(kind).alias("i", "x"))
        every = hits if every is None else every.union(hits)
    before = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    every = every.select("row", "kind", "i", F.length("x.hit").alias("size"), F.col("x.gap").alias("gap"), F.col("x.value").alias("value"))
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("long")
    every = every.select("row", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value")
    every = every.filter((F.col("kind") > 0) | (F.length("value") >= VALUE))
    base = F.col("kind") < 3
    order = W.partitionBy("row").orderBy("start", "kind")
    # a base span of the same start is read before a run by its kind
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    every = every.withColumn("reach", reach)
    return every.filter(base | (F.coalesce("reach", F.lit(0)) < F.col("end"))).drop("reach")


def _random_runs(spans: DataFrame, false_alarm: float, holdout: int) -> DataFrame | None:
    """The runs that the models take for random strings."""
    runs = spans.filter("kind = 3").withColumn("folded", _fold(F.col("value")))
    runs = runs.select("*", *markov.key(F.col("folded")))
    ordinary = runs.filter(F.col("value").rlike(r"^[A-Za-z_]+$")).select("value").distinct()
    held = F.pmod(F.xxhash64("value"), F.lit(holdout)) == 0
    written = F.substr(F.base64(F.unhex(F.sha2("value", 256))), F.lit(1), F.length("value"))
    random = spans.filter("kind < 3").select("value").union(ordinary.filter(~held).select(written.alias("value"))).distinct()
    samples = (
        random.select(_fold(F.col("value")).alias("folded"), F.lit(1).alias("pos"), F.lit(0).alias("neg"))
        .union(ordinary.filter(~held).select(_fold(F.col("value")), F.lit(0), F.lit(1)))
        .union(runs.select("folded", F.lit(0), F.lit(0)))  # so that the table has their grams
    )
    counts = store(markov.gram_counts(samples.groupBy("folded").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ORDER), "secret-grams")
    classes = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not (classes[0] and classes[1]):
        return None
    model = store(markov.log_ratio(counts, ORDER, SYMBOLS), "secret-model")
    scored = store(markov.scores(runs, model, ORDER), "secret-scores")
    calm = ordinary.filter(held).select(*markov.key(_fold(F.col("value")))).join(scored, ["f1", "f2"])
    cut = max(0.0, calm.agg(F.percentile_approx("score", 1 - false_alarm, 10000)).first()[0] or 0.0)
    return runs.join(scored.filter(F.col("score") > cut), ["f1", "f2"]).select(*spans.columns)


def find_spans(scanned: DataFrame, false_alarm: float = 0.001, holdout: int = 5) -> DataFrame:
    """(row, kind, start, end, value) of all secrets of a stored scan; kind is
    the number in ``KINDS``."""
    spans = store(_spans(scanned), "secret-spans")
    found = _random_runs(spans, false_alarm, holdout)
    base = spans.filter("kind < 3")
    return base if found is None else base.union(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, spans) of every row; spans: array of (start, kind, end,
    value) in order of start and kind, kind being the number in ``KINDS``."""
    scanned = store(scan_texts(docs, id_col, text_col), "secret-scan")
    spans = find_spans(scanned)
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value"))).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return scanned.select("row", "id").join(listed, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``;
    overlapping spans are one."""
    row, cuts = free_name(docs, "secret_row"), free_name(docs, "secret_cuts")
    stored = store(docs.withColumn(row, F.monotonically_increasing_id()), "secret-docs")
    scanned = store(scan_texts(stored, row, text_col).drop("row").withColumnRenamed("id", "row"), "secret-scan")
    order = W.partitionBy("row").orderBy("start", "end")
    spans = find_spans(scanned).select("row", "start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(reach <= F.col("start"), F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = spans.groupBy("row", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias(cuts)).withColumnRenamed("row", row)
    text, c = F.col(f"`{text_col}`"), F.col(cuts)

    def before(x, i):
        begin = F.coalesce(F.get(c, i - 1)["e"], F.lit(0))
        return F.concat(F.substr(text, (begin + 1).cast("int"), (x["s"] - begin).cast("int")), F.lit(mask))

    tail = F.substr(text, (F.element_at(c, -1)["e"] + 1).cast("int"))
    clean = F.when(c.isNull(), text).otherwise(F.concat(F.array_join(F.transform(c, before), ""), tail))
    joined = stored.join(listed, row, "left")
    return joined.select(*(clean.alias(x) if x == text_col else F.col(f"`{x}`") for x in docs.columns))
