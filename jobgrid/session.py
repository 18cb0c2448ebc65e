"""Session and shared-folder helpers.

Everything that must survive an executor loss (checkpoints, written
intermediate tables, snapshots written by queries) goes under the folder the
cluster names in ``spark.checkpoint.dir``.  A folder is made up only when that
setting is unset *and* the master is local (tests, the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = "*", app: str = "jobgrid", extra: dict | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    for a local master is a folder created when neither is set.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    d = tempfile.mkdtemp(prefix="jobgrid-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    base = shared_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage by writing ``df`` as a Parquet table in the shared
    folder and reading it back (never a local checkpoint): durable if an
    executor is lost, columnar and pruned when re-read."""
    return write_cut(df, name)[0]


def write_cut(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """``cut_lineage`` that also tells the folder, for ``remove_path`` once
    nothing reads the table any more."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table this session wrote under the shared folder; anything
    elsewhere is refused."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not under the shared folder")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_local_path(p: str) -> bool:
    return p.startswith("/") or p.startswith("file:")


def spread(df: DataFrame) -> DataFrame:
    """Spread an under-split scan over the cluster's cores.

    A file that is one Parquet row group (or an unsplittable format) is read
    by one task, and every narrow step after it runs serially until the first
    shuffle.  When the scan has fewer partitions than the default parallelism,
    its rows are dealt by their place in it, which a scan repeats; unlike a
    round-robin repartition that needs no sort of what a task has read, and the
    tasks are as many as the session's shuffles have, joined by AQE when small.
    A normally split table (many files or row groups) is returned unchanged,
    with no extra shuffle.  ``df`` must be a scan."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target or df.select(F.spark_partition_id()).distinct().count() < target:
        return df.withColumn("_at", F.monotonically_increasing_id()).repartition("_at").drop("_at")
    return df
