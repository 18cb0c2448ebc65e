"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrid.llm import (
    ann,
    bpe,
    class_lm,
    frames,
    lexical_search,
    license_scan,
    oracles,
    packing,
    quality_rules,
    repeats,
    secret_scan,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op3_quality_rules", oracles.QUALITY_RULES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, m = quality_rules.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    cols = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select("doc_id", *(f"{m}.{c}" for c in cols))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(*cols)


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base_labels = F.array_sort(F.array_distinct("base.label"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, "method_labels")), ",").alias("labels"),
        "score",
    )


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_suffix_dedup", oracles.SUFFIX_DEDUP)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = frames.text_of()
    rows = docs.select("doc_id", *repeats.text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = suffix_dedup.cut_texts(docs).select(
        "t1", "t2", F.size("starts").cast("long").alias("spans"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("cut_sha")
    )
    copied = F.col("copies").isNotNull()
    return rows.join(suffix_dedup.copied_texts(docs), ["t1", "t2"], "left").join(cut, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


@query("op6_substring_dedup", oracles.SUBSTRING_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = frames.text_of()
    rows = docs.select("doc_id", substring_dedup.rank_of("doc_id").alias("d"), *repeats.text_key(text), substring_dedup.joined_words(text).alias("w"))
    rows = rows.select("doc_id", "d", "t1", "t2", F.col("w.n").alias("n_words"), F.sha2("w.joined", 256).alias("sha"))
    cut = substring_dedup.cut_texts(docs).select("t1", "t2", "removed", F.sha2("kept", 256).alias("cut_sha"))
    whole = (F.col("d") > F.col("least")) & (F.col("n_words") >= substring_dedup.WORDS)  # a copy of an earlier document
    return rows.join(substring_dedup.copied_texts(docs), ["t1", "t2"], "left").join(cut, ["t1", "t2"], "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(k) for k in secret_scan.KINDS))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{secret_scan.KINDS[kind]}")

    base, counts = F.filter("spans", lambda x: x["kind"] < 3), [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op7_ann")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_class_lm")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(table(spark, sf_dir, "documents"))


@query("op13_lexical_search", oracles.LEXICAL_SEARCH)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
