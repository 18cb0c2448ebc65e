"""Rows in a total order, by ranges: any page and any stretch of a feed without
sorting what stands before it (SURVEY §2.7, §2.4).

``<root>/rows/r=<range>/`` holds the rows of a range with their place ``pos`` in
it, ``<root>/ranges`` the rows of each range (``n``) and the rank of its first
(``first``).  Ranges come from a range partitioning by the order, so a hot
leading value lies in several of them, and a rank is ``first + pos``: no window
over the table or over a key.  A page reads the one or two ranges that hold it.
What one task sums up, and what comes to the driver for a page, are range
numbers: rows / ``RANGE_ROWS``, and at most ``MOST_RANGES`` (a larger table has
longer ranges), since each is a task and a folder, and every task before the
shuffle writes a block for each.  An empty table has one range without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrid.operators.filters import with_type
from jobgrid.operators.paging import LISTING_ORDER, _check

RANGE_ROWS = 500_000
MOST_RANGES = 1000
#: ``monotonically_increasing_id``: the partition above 33 bits, the row in it below
_ROW_BITS = 33
#: copies of each page in the feed's last join, so that users of one page lie in as many tasks
SALTS = 16


@dataclass
class RankIndex:
    spark: SparkSession
    root: str
    schema: T.StructType
    order: tuple[str, ...]

    @staticmethod
    def build(df: DataFrame, root: str, order: tuple[str, ...] = LISTING_ORDER, range_rows: int = RANGE_ROWS) -> RankIndex:
        """Write ``df`` by ranges of ``order``, which must be total; ``range_rows``
        in each, or more in a table that would have over ``MOST_RANGES``."""
        index = RankIndex(df.sparkSession, root, df.schema, tuple(order))
        ranges = min(df.count() // int(range_rows) + 1, MOST_RANGES)
        at = F.monotonically_increasing_id()
        placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("pos", at)
        r = F.shiftrightunsigned("pos", _ROW_BITS).cast("int")
        placed = placed.withColumn("r", r).withColumn("pos", F.col("pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        placed.write.partitionBy("r").parquet(f"{root}/rows")
        before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        counts = index._rows().groupBy("r").agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{root}/ranges")
        return index

    def _rows(self, ranges: list[int] | None = None) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.schema.fields]
        schema = T.StructType([*fields, T.StructField("pos", T.LongType()), T.StructField("r", T.IntegerType())])
        at = f"{self.root}/rows"
        paths = [at] if ranges is None else [f"{at}/r={r}" for r in ranges]
        return self.spark.read.schema(schema).option("basePath", at).parquet(*paths)

    def ranges(self) -> DataFrame:
        return self.spark.read.schema("r int, n long, first long").parquet(f"{self.root}/ranges")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        found = rows.join(self.ranges().select("r", "first"), "r").withColumn("rank", F.col("first") + F.col("pos"))
        return found.select(*[f"`{c}`" for c in self.schema.names], "rank")

    def ranked(self) -> DataFrame:
        """All rows with their ``rank`` in the order, from 0."""
        return self._ranked(self._rows())

    def between(self, begin: int, end: int) -> DataFrame:
        """The rows of rank ``begin`` to ``end - 1``, with their ``rank``."""
        held = self.ranges().filter((F.col("first") < end) & (F.col("first") + F.col("n") > begin))
        wanted = [x.r for x in held.select("r").collect()]
        rows = self._rows(wanted) if wanted else self._rows().limit(0)
        return self._ranked(rows).filter((F.col("rank") >= begin) & (F.col("rank") < end))


def page(index: RankIndex, page: int = 1, limit: int = 250) -> DataFrame:
    """Page ``page`` of ``limit`` rows, however deep."""
    _check(page, limit)
    begin = (int(page) - 1) * int(limit)
    return index.between(begin, begin + int(limit)).orderBy("rank").drop("rank")


def load_more(index: RankIndex, pages: int, limit: int = 250) -> DataFrame:
    """Pages 1 to ``pages``, with their ``rank`` and spread over tasks as they are stored."""
    _check(pages, limit)
    return index.between(0, int(pages) * int(limit))


# ---- feeds -------------------------------------------------------------------------


def feed_key(preference) -> F.Column:
    """The list that a preference reads: one for all blank ones, and one a value."""
    blank = F.coalesce(preference, F.lit("")) == ""
    return F.when(blank, F.lit("all")).otherwise(F.concat(F.lit("="), preference))


def build_feeds(listings: DataFrame, root: str, order: tuple[str, ...] = LISTING_ORDER, range_rows: int = RANGE_ROWS) -> RankIndex:
    """The listings of each preference value (``type`` or ``duration``) and of
    none, in one ranking by (list, order)."""
    lst = with_type(listings).select("job_id", *[c for c in order if c != "job_id"], "type", "duration")
    vals = F.array_distinct(F.filter(F.array("type", "duration"), lambda v: v.isNotNull() & (v != "")))
    keys = F.concat(F.array(F.lit("all")), F.transform(vals, feed_key))
    return RankIndex.build(lst.select(F.explode(keys).alias("feed_key"), *order), root, ("feed_key", *order), range_rows)


def feed_after(users: DataFrame, feeds: RankIndex, limit: int = 250) -> DataFrame:
    """(user_id, job_id, feed_rank): for each user the ``limit`` listings that
    follow the first ``seen`` (null: 0) of the list of ``preferred_job_type``.

    Users who ask for the same page share it: pages are cut once, by equal
    blocks of ranks (so lists of any length lie in many tasks), and then met by
    their users, salted."""
    _check(1, limit)
    asked_by = users.select(
        "user_id", feed_key(F.col("preferred_job_type")).alias("feed_key"),
        F.coalesce(F.col("seen").cast("long"), F.lit(0)).alias("seen"),
        F.pmod(F.xxhash64("user_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = feeds.ranked()
    lead = rows.groupBy("feed_key").agg(F.min("rank").alias("lead"))
    block = lambda rank: F.floor(rank / limit)
    asked = asked_by.select("feed_key", "seen").distinct().join(lead, "feed_key").withColumn("begin", F.col("lead") + F.col("seen"))
    asked = asked.withColumn("block", F.explode(F.sequence(block(F.col("begin")), block(F.col("begin") + limit - 1))))
    rows = rows.select(F.col("feed_key").alias("list"), "job_id", "rank", block(F.col("rank")).alias("block"))
    cut = asked.join(rows, "block").filter(
        (F.col("list") == F.col("feed_key")) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("begin") + limit)
    )
    pages = cut.select("feed_key", "seen", "job_id", (F.col("rank") - F.col("lead") + 1).alias("feed_rank"))
    pages = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked_by.join(pages, ["feed_key", "seen", "salt"]).select("user_id", "job_id", "feed_rank")
