"""A listing table in key buckets: a step writes in proportion to what it
changes (SURVEY §2.8, the upserts and the refresh).

``<root>/rows/v=<version>/b=<bucket>/`` holds rows by the hash of their id, and
``<root>/<index>/v=…/b=…/`` the entries (key text, id, order columns) of an
index by the hash of the key.  A commit writes the rows it changed and the
entries it added or withdrew, as new files of the buckets that they fall into,
and then one record to the append-only log ``<root>/_log`` that names these
buckets.  Nothing else is rewritten and nothing is overwritten, so readers see
whole versions, a failed write leaves no trace in the log, and a commit that a
stream repeats is known by its writer and batch.

*Merge on read.*  A bucket is its last base and the deltas after it; the row of
the highest version stands for its id, and a row marked as gone for none.  Only
buckets with deltas pay for that; those with one delta only by a test whether it
has a row in place of theirs: it marks (``_old``) what was there before it.  ``compact`` rewrites the buckets whose deltas
have grown as a new base; ``vacuum`` deletes what no longer counts.

*Look-ups* read the index buckets of the wanted keys, then the row buckets of
the ids found.  Bucket numbers (bounded by the table's bucket count) are all
that comes to the driver, besides the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrid.operators import merge
from jobgrid.session import remove_path, write_cut

ROWS = "rows"
#: rows of a bucket when a table is created
BUCKET_ROWS = 500_000
#: replaced entries (texts of 30 bytes or so) that are sent to every task
MOST_BROADCAST = 300_000
_LOG = "version LONG, buckets INT, writer STRING, batch LONG, parts ARRAY<STRUCT<kind STRING, base BOOLEAN, b INT, n LONG>>"


def key_text(*cols) -> Column:
    """Key columns as one text; a null differs from every value, and no two
    keys share a text."""
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in cols]
    return F.concat(*marked)


#: the indexes of the listing table: every upsert and the dedupe match by one of them
LISTING_INDEXES: dict[str, Callable[[], Column]] = {"by_url": lambda: key_text("job_url"), "by_title": merge.dedupe_key}


@dataclass
class KeyedTable:
    spark: SparkSession
    root: str
    schema: T.StructType
    order: tuple[str, ...] = merge.LISTING_ORDER
    id_col: str = "job_id"
    indexes: dict[str, Callable[[], Column]] = field(default_factory=lambda: LISTING_INDEXES)

    # ---- log -----------------------------------------------------------------

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.root}/_log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def version(self) -> int | None:
        return self.log().agg(F.max("version")).first()[0]

    def buckets(self) -> int:
        return self.log().agg(F.max("buckets")).first()[0]

    def committed(self, writer: str, batch: int) -> int | None:
        return self.log().filter((F.col("writer") == writer) & (F.col("batch") == batch)).agg(F.max("version")).first()[0]

    def live(self, version: int | None = None) -> dict[str, dict[int, list[tuple[int, bool, int]]]]:
        """By kind and bucket: its last base and the deltas after it, as
        (version, base, rows); bounded by buckets times deltas not compacted."""
        log = self.log() if version is None else self.log().filter(F.col("version") <= version)
        parts = log.select("version", F.inline("parts"))
        since = F.max(F.when(F.col("base"), F.col("version"))).over(Window.partitionBy("kind", "b"))
        out: dict = {}
        for v, kind, base, b, n in parts.withColumn("_since", since).filter("version >= _since").select("version", "kind", "base", "b", "n").collect():
            out.setdefault(kind, {}).setdefault(b, []).append((v, base, n))
        for parts in (x for kind in out.values() for x in kind.values()):
            parts.sort()  # the base first: the log is read in any order
        return out

    # ---- reading -------------------------------------------------------------

    def _schema_of(self, kind: str) -> T.StructType:
        if kind == ROWS:
            cols = [f for f in self.schema.fields]
        else:
            own = [self.id_col, *(c for c in self.order if c != self.id_col)]
            cols = [T.StructField("k", T.StringType()), *(self.schema[c] for c in own)]
        return T.StructType([*cols, T.StructField("_gone", T.BooleanType()), T.StructField("_old", T.BooleanType()), T.StructField("v", T.LongType()), T.StructField("b", T.IntegerType())])

    def _current(self, kind: str, key: list[str], only: set[int] | None = None, version: int | None = None) -> DataFrame:
        """The entries of a kind that stand, from all or some buckets."""
        live = {b: x for b, x in self.live(version).get(kind, {}).items() if only is None or b in only}
        schema = self._schema_of(kind)

        def read(buckets):
            dirs = [f"{self.root}/{kind}/v={v}/b={b}" for b, parts in buckets.items() for v, _, n in parts if n]
            if not dirs:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*dirs)

        out = read({b: x for b, x in live.items() if len(x) == 1})
        grown = {b: x for b, x in live.items() if len(x) > 1}
        if grown:
            bases, deltas = read({b: x[:1] for b, x in grown.items()}), read({b: x[1:] for b, x in grown.items()})
            old = F.coalesce("_old", F.lit(True))
            n_old = self._replaced(bases, deltas, old, key) if all(len(x) == 2 for x in grown.values()) else None
            if n_old is not None:
                replaced = deltas.filter(old).select(*key)
                replaced = F.broadcast(replaced) if n_old <= MOST_BROADCAST else replaced  # then the bases stay where they are
                out = out.unionByName(bases.join(replaced, key, "left_anti")).unionByName(deltas)
            else:
                newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("v")))
                out = out.unionByName(bases.unionByName(deltas).withColumn("_rn", newest).filter("_rn = 1").drop("_rn"))
        return out.filter(~F.coalesce("_gone", F.lit(False))).drop("_gone", "_old", "v", "b")

    def _replaced(self, bases: DataFrame, deltas: DataFrame, old: Column, key: list[str]) -> int | None:
        """How many entries of the deltas say that they stand for one of the
        bases; None if a key is null or comes twice otherwise.  Of each entry
        only a hash is shuffled."""
        h = F.when(reduce(and_, (F.col(c).isNotNull() for c in key)), F.xxhash64(*key)).alias("h")
        marks = bases.select(h, F.lit(False).alias("o")).union(deltas.select(h, old.alias("o")))
        per = marks.groupBy("h", "o").agg(F.count(F.lit(1)).alias("n"))
        got = per.agg(F.count_if(F.col("o")).alias("n"), F.count_if(F.col("h").isNull() | (F.col("n") > 1)).alias("odd")).first()
        return None if got["odd"] else got["n"]

    def read(self, version: int | None = None) -> DataFrame:
        return self._current(ROWS, [self.id_col], version=version)

    def _touched(self, df: DataFrame, by: str) -> set[int]:
        bucket = F.pmod(F.xxhash64(by), F.lit(self.buckets())).cast("int")
        return {r[0] for r in df.select(bucket).distinct().collect()}  # at most the buckets

    def held(self, index: str, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (a column ``k`` of key texts) that a row has, told by
        the index alone."""
        found = self._current(index, ["k", self.id_col], self._touched(keys, "k")).select("k")
        return keys.join(found, "k", "left_semi")

    def lookup(self, index: str, keys: DataFrame, first: bool = False) -> DataFrame:
        """The rows that have one of ``keys`` (a column ``k`` of key texts); with
        ``first`` the first one of each key only, in the table's order."""
        found = self._current(index, ["k", self.id_col], self._touched(keys, "k")).join(keys.select("k").distinct(), "k", "left_semi")
        if first:
            rn = F.row_number().over(Window.partitionBy("k").orderBy(*self.order, *([self.id_col] if self.id_col not in self.order else [])))
            found = found.withColumn("_rn", rn).filter("_rn = 1")
        return self.rows_of(found.select(self.id_col))

    def rows_of(self, ids: DataFrame) -> DataFrame:
        ids, _ = write_cut(ids.distinct(), "keyed-ids")
        return self._current(ROWS, [self.id_col], self._touched(ids, self.id_col)).join(ids, self.id_col, "left_semi")

    # ---- writing -------------------------------------------------------------

    def _write(self, kind: str, df: DataFrame, by: str, version: int, base: bool, n_buckets: int) -> list[tuple]:
        path = f"{self.root}/{kind}/v={version}"
        h = F.xxhash64(by)
        # a bucket is written by several tasks (joined by AQE when small), so no task holds a bucket, however few there are
        tasks = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n_buckets)
        part = F.pmod(F.shiftrightunsigned(h, 32), F.lit(tasks))
        dealt = df.withColumn("b", F.pmod(h, F.lit(n_buckets)).cast("int")).repartition("b", part)
        dealt.write.mode("overwrite").partitionBy("b").parquet(path)  # what a failed, unlogged write left goes
        done = self.spark.read.schema(T.StructType([T.StructField("b", T.IntegerType())])).parquet(path)
        return [(kind, base, r["b"], r["count"]) for r in done.groupBy("b").count().collect()]

    def _record(self, version: int, n_buckets: int, parts: list[tuple], writer: str | None, batch: int | None) -> int:
        self.spark.createDataFrame([(version, n_buckets, writer, batch, parts)], _LOG).coalesce(1).write.mode("append").json(f"{self.root}/_log")
        return version

    def _entries(self, df: DataFrame, index: str) -> DataFrame:
        own = [self.id_col, *(c for c in self.order if c != self.id_col)]
        return df.select(self.indexes[index]().alias("k"), *own)

    def create(self, df: DataFrame, buckets: int | None = None) -> int:
        """The first version: ``df`` as base files of every bucket."""
        if self.version() is not None:
            raise ValueError(f"a table stands under {self.root}")
        n = buckets or 1 + df.count() // BUCKET_ROWS
        df = df.select(*self.schema.fieldNames()).withColumn("_gone", F.lit(False))
        parts = self._write(ROWS, df, self.id_col, 0, True, n)
        rows = self.spark.read.schema(T.StructType(self._schema_of(ROWS).fields[:-3])).parquet(f"{self.root}/{ROWS}/v=0")
        for index in self.indexes:
            parts += self._write(index, self._entries(rows, index).withColumn("_gone", F.lit(False)), "k", 0, True, n)
        # every bucket has a base, if an empty one
        held = {(kind, b) for kind, _, b, _ in parts}
        parts += [(kind, True, b, 0) for kind in (ROWS, *self.indexes) for b in range(n) if (kind, b) not in held]
        return self._record(0, n, parts, None, None)

    def commit(self, changes: DataFrame, old: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """``changes``: the new rows, and the ids of rows that go with ``_gone``
        set; ``old``: what stands now under these ids.  ``_old``, if it is a
        column, tells which of the ids stand in the table.  A batch that its
        writer has committed is not written again."""
        if writer is not None and (done := self.committed(writer, batch)) is not None:
            return done
        version, n = self.version() + 1, self.buckets()
        stood = F.coalesce("_old", F.lit(True)) if "_old" in changes.columns else F.lit(True)
        changes, path = write_cut(changes.select(*self.schema.fieldNames(), F.coalesce("_gone", F.lit(False)).alias("_gone"), stood.alias("_old")), "keyed-changes")
        parts = self._write(ROWS, changes, self.id_col, version, False, n)
        read = [path]
        if self.indexes:  # every index reads it twice: the caller's plan runs once
            own = [self.id_col, *(c for c in self.order if c != self.id_col)]
            held, held_path = write_cut(old.select(*own, *(f().alias(f"_k_{i}") for i, f in self.indexes.items())), "keyed-old")
            read.append(held_path)
        for index in self.indexes:
            new = self._entries(changes.filter("NOT _gone"), index)
            was = held.select(F.col(f"_k_{index}").alias("k"), *own)
            added = new.join(was.select("k", self.id_col), ["k", self.id_col], "left_anti").withColumns({"_gone": F.lit(False), "_old": F.lit(False)})
            left = was.join(new.select("k", self.id_col), ["k", self.id_col], "left_anti").withColumns({"_gone": F.lit(True), "_old": F.lit(True)})
            parts += self._write(index, added.unionByName(left), "k", version, False, n)
        out = self._record(version, n, parts, writer, batch)
        for p in read:
            remove_path(self.spark, p)
        return out

    def compact(self, share: float = 0.5, deltas: int = 16) -> int | None:
        """Rewrite the buckets with more than ``deltas`` deltas, or whose deltas
        hold more than ``share`` of the base's rows."""
        live, n, parts = self.live(), self.buckets(), []
        version = self.version() + 1
        for kind, by, key in ((ROWS, self.id_col, [self.id_col]), *((i, "k", ["k", self.id_col]) for i in self.indexes)):
            grown = {b for b, x in live.get(kind, {}).items() if len(x) > 1 and (len(x) - 1 > deltas or sum(r for _, base, r in x if not base) > share * x[0][2])}
            if grown:
                now = self._current(kind, key, grown).withColumn("_gone", F.lit(False))
                wrote = self._write(kind, now, by, version, True, n)
                parts += wrote + [(kind, True, b, 0) for b in grown - {p[2] for p in wrote}]
        return self._record(version, n, parts, None, None) if parts else None

    def vacuum(self) -> int:
        """Delete the files of buckets that a later base replaced; how many
        bucket folders went.  Readers of older versions must be done."""
        live = {(kind, v, b) for kind, x in self.live().items() for b, parts in x.items() for v, _, _ in parts}
        gone = [p for p in self.log().select("version", F.inline("parts")).filter("n > 0").select("kind", "version", "b").collect() if tuple(p) not in live]
        for kind, v, b in gone:
            remove_path(self.spark, f"{self.root}/{kind}/v={v}/b={b}")
        return len(gone)


def upsert(table: KeyedTable, batch: DataFrame, keys: list[str], written: list[str] | None = None,
           writer: str | None = None, at: int | None = None) -> int:
    """``merge.upsert`` into the table: reads the buckets of the batch's keys,
    writes the rows that it changes or adds."""
    index, text = ("by_url", key_text("job_url")) if keys == ["job_url"] else ("by_title", merge.dedupe_key())
    if written is None:
        written = [c for c in batch.columns if c not in (table.id_col, *table.order)]
    # by link the index knows the first row; by title it knows more than the keys ask for
    near, near_path = write_cut(table.lookup(index, batch.select(text.alias("k")), first=keys == ["job_url"]), "keyed-near")
    matches, matches_path = write_cut(merge.upsert_matches(near, batch, keys, table.order, table.id_col, written), "keyed-matches")
    updates, inserts = merge.upsert_split(matches, table.order, table.id_col, written)
    changed = merge.overlay(near, updates, written, table.id_col, how="inner")
    changes = changed.withColumn("_old", F.lit(True)).unionByName(inserts.withColumn("_old", F.lit(False)), allowMissingColumns=True).withColumn("_gone", F.lit(False))
    old = near.join(updates.select(F.col("_uid").alias(table.id_col)), table.id_col, "left_semi")
    out = table.commit(changes, old, writer, at)
    for p in (near_path, matches_path):
        remove_path(table.spark, p)
    return out
