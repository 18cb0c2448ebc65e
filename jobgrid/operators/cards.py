"""Display projections of a listing."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrid.functions.text import (
    CARD_NOT_DISCLOSED,
    DEFAULT_COLOUR,
    NA,
    SOURCE_COLOURS,
    UNKNOWN_SOURCE,
    initial,
    nonempty,
)
from jobgrid.operators.filters import with_type


def _colour(src):
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(SOURCE_COLOURS.items())])
    return F.coalesce(F.element_at(m, src), F.lit(DEFAULT_COLOUR))


def _common(df: DataFrame):
    src = nonempty("source", UNKNOWN_SOURCE)
    return [
        F.col("job_id"),
        src.alias("source_label"),
        F.lower(src).alias("source_class"),
        initial("company").alias("initial"),
        nonempty("title", NA).alias("title_text"),
        nonempty("company", NA).alias("company_text"),
        nonempty("location", NA).alias("location_text"),
    ], src


def _pay(df: DataFrame):
    salary = F.col("salary") if "salary" in df.columns else F.lit(None).cast("string")
    return nonempty("stipend", nonempty(salary, CARD_NOT_DISCLOSED)).alias("pay")


def saved_ids(saved: DataFrame, user_id) -> DataFrame:
    """One user's saved job ids (deduplicated)."""
    return saved.filter(F.col("user_id") == F.lit(user_id)).select("job_id").distinct()


def saved_flag(listings: DataFrame, saved: DataFrame, user_id) -> DataFrame:
    """Each listing with whether ``user_id`` saved it.  A left join to the
    user's id set; AQE broadcasts it when its measured size is small."""
    ids = saved_ids(saved, user_id).withColumn("_saved", F.lit(True))
    return listings.join(ids, "job_id", "left").withColumn(
        "is_saved", F.coalesce(F.col("_saved"), F.lit(False))
    ).drop("_saved")


def listing_card(listings: DataFrame, saved: DataFrame | None = None, user_id=None) -> DataFrame:
    """Card of the listing page: labels with defaults, tags from (type,
    duration), pay from stipend, else salary, colour by source, saved flag."""
    df = with_type(listings)
    if saved is not None and user_id is not None:
        df = saved_flag(df, saved, user_id)
    else:
        df = df.withColumn("is_saved", F.lit(False))
    cols, src = _common(df)
    tags = F.array_join(F.array(F.nullif("type", F.lit("")), F.nullif("duration", F.lit(""))), "|")
    return df.select(
        *cols,
        tags.alias("tags"),
        _pay(df),
        (F.coalesce(F.col("job_url"), F.lit("")) != "").alias("can_apply"),
        _colour(src).alias("colour"),
        F.col("is_saved"),
    )


def saved_card(saved_listings: DataFrame) -> DataFrame:
    """Card of the saved page: a single tag (type, else duration, else N/A)."""
    df = with_type(saved_listings)
    cols, src = _common(df)
    return df.select(
        *cols,
        nonempty("type", nonempty("duration", NA)).alias("tag"),
        _pay(df),
        (F.coalesce(F.col("job_url"), F.lit("")) != "").alias("can_apply"),
        _colour(src).alias("colour"),
    )
