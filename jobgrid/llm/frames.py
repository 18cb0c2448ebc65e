"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrid.session import shared_dir

#: a word is a run of anything but blanks
WORD = r"[^\x20\x09-\x0D]+"
#: rows up to which a side may be broadcast after it has been counted
BROADCAST_ROWS = 200_000
#: rows of an Arrow batch of whole texts; 10000, Spark's own number, are tens of MB on either side of the pipe
TEXT_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_of(col: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have few rows; else as
    it is, so that the join shuffles and Spark splits its skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What runs inside gets Arrow batches of ``rows`` rows at most."""
    before = int(spark.conf.get(_BATCH_ROWS))
    spark.conf.set(_BATCH_ROWS, str(rows if before <= 0 else min(rows, before)))  # 0 and less: no limit
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, str(before))


def store(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once and kept as a checkpoint in the folder that the
    cluster shares (``spark.checkpoint.dir``): a lost executor loses none of
    it, and row numbers in it stay as they are.  Spark removes the files with
    the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = df.sparkSession.sparkContext
    shared_dir(df.sparkSession)
    context.setJobDescription(what)
    try:
        return df.checkpoint()
    finally:
        context.setJobDescription(None)
