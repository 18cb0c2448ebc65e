"""Embedded saved arrays as a table of elements with their payload (SURVEY
§2.8): one row an element, arrays only built for output.

Elements: ``user_id``, the order columns (``batch``, ``ts``, ``n``) and
``element``, a VARIANT that is a string or an object.  Requests: ``user_id``,
``ts``, ``request_id``, ``action`` (``save`` / ``unsave``), ``body`` (VARIANT,
of a save) and ``target`` (the id of an unsave).

A save appends its body unless a live element of the user has its id (``jobId``,
else ``id``, else the string itself) as string, ``jobId`` or ``id``; a body
without an id always appends.  An unsave removes every element that has its
target as string, ``jobId``, ``id`` or ``_id``.  Ids are equal only with equal
types, and a number is no string.  A null or empty body is ``empty``.

Requests act on each other only through ids, so the fold runs by components: the
ids of a user, joined where one element names two of them.  A component is read
in order by one task, which holds its live elements' ids; payloads take no part
and meet the outcome by their order columns.  Elements of users without a
request, and bodies without an id, pass by the fold.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.operators.components import components
from jobgrid.session import cut_lineage

KEY = ["user_id", "batch", "ts", "n"]
_THERE, _SAVE, _UNSAVE = 0, 1, 2
_OUT = "user_id long, batch long, ts timestamp_ntz, n long, what int, status string"


def _ident(v: Column) -> Column:
    """A variant value as an id: its type and text; null for what does not count."""
    text = F.to_json(v)
    falsy = v.isNull() | F.is_variant_null(v) | text.isin('""', "0", "false")
    return F.when(~falsy, F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit("s"), v.cast("string"))).otherwise(F.concat(F.lit("j"), text)))


def _at(name: str) -> Column:
    # a path into a value that is no object gives null
    return _ident(F.try_variant_get("element", f"$.{name}", "variant"))


def _read(rows: DataFrame) -> DataFrame:
    """Rows with the ids of ``element``: ``check``, ``ids`` and ``oid``."""
    is_text = F.schema_of_variant("element") == "STRING"
    rows = rows.withColumns({"_s": F.when(is_text, _ident(F.col("element"))), "_j": _at("jobId"), "_i": _at("id"), "oid": _at("_id")})
    ids = F.array_distinct(F.array_compact(F.array("_s", "_j", "_i")))
    return rows.withColumns({"check": F.coalesce("_j", "_i", "_s"), "ids": ids}).drop("_s", "_j", "_i")


def _node(ident: Column | str) -> Column:
    return F.xxhash64("user_id", ident)


def _fold(batches):
    """Rows in order of (user, component, time) → the status of each request,
    and ``live`` for each element that stands at the end."""
    group, live, by_id, by_any = None, {}, defaultdict(set), defaultdict(set)

    def ended():
        out = [(group[0], *key, what, "live") for key, (what, _, _) in live.items()]
        live.clear(), by_id.clear(), by_any.clear()
        return out

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.timestamp("us"), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["user_id", *KEY[1:], "what", "status"])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            here = (row["user_id"], row["comp"])
            if here != group:
                if group is not None:
                    out += ended()
                group = here
            key, what, check, ids, oid = (row["batch"], row["ts"], row["n"]), row["what"], row["check"], row["ids"] or [], row["oid"]
            status = None
            if what == _UNSAVE:
                gone = by_any.pop(check, set())
                for k in gone:
                    _, mine, other = live.pop(k)
                    for x in mine:
                        by_id[x].discard(k), by_any[x].discard(k)
                    by_any[other].discard(k)
                status = "removed" if gone else "not_found"
            elif what == _SAVE and check is not None and by_id.get(check):
                status = "already_saved"
            else:
                live[key] = (what, ids, oid)
                for x in ids:
                    by_id[x].add(key), by_any[x].add(key)
                if oid is not None:
                    by_any[oid].add(key)
                status = "created" if what == _SAVE else None
            if status:
                out.append((row["user_id"], *key, what, status))
        if out:
            yield table(out)
    if group is not None and (rest := ended()):
        yield table(rest)


def apply(elements: DataFrame, requests: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """(elements after, statuses (request_id, status)) of one batch of
    requests, served in (ts, request_id) order; ``batch`` must be above those of
    the elements there."""
    cols = [*KEY, "element"]
    asked = requests.select("user_id", F.lit(int(batch)).cast("long").alias("batch"), "ts", F.col("request_id").cast("long").alias("n"), "action", "body", "target")
    text = F.to_json("body")
    empty = (F.col("action") == "save") & (F.col("body").isNull() | F.is_variant_null("body") | text.isin('""', "{}", "0", "false"))
    saves = asked.filter((F.col("action") == "save") & ~empty).withColumnRenamed("body", "element")
    saves = _read(saves.select(*cols)).withColumn("what", F.lit(_SAVE))
    touched = elements.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    there = _read(touched.select(*cols)).withColumn("what", F.lit(_THERE))
    body = there.unionByName(saves)
    named = F.when(F.size("ids") > 0, F.get("ids", F.lit(0))).otherwise(F.col("oid"))
    every = F.array_distinct(F.array_compact(F.concat("ids", F.array("oid"))))
    links = body.filter(F.size(every) > 1).select(_node(named).alias("a"), F.explode(F.transform(every, _node)).alias("b"))
    comps = components(links).withColumnsRenamed({"node": "_node", "component": "_comp"})
    unsaves = asked.filter(F.col("action") == "unsave").select(
        *KEY, F.lit(_UNSAVE).alias("what"), F.concat(F.lit("s"), "target").alias("check"),
        F.array().cast("array<string>").alias("ids"), F.lit(None).cast("string").alias("oid"),
    )
    events = body.drop("element").withColumn("_named", named).unionByName(unsaves.withColumn("_named", F.col("check")))
    events = events.filter(F.col("_named").isNotNull()).withColumn("_node", _node("_named"))
    events = events.join(comps, "_node", "left").withColumn("comp", F.coalesce("_comp", "_node"))
    fed = events.select("user_id", "comp", "batch", "ts", "n", "what", "check", "ids", "oid")
    fed = fed.repartition("user_id", "comp").sortWithinPartitions("user_id", "comp", "batch", "ts", "n")
    done = cut_lineage(fed.mapInArrow(_fold, _OUT), "saved-elements")
    stay = body.filter(named.isNull()).select(*cols)
    live = body.join(done.filter("status = 'live'").select(*KEY), KEY, "left_semi").select(*cols)
    others = elements.select(*cols).join(asked.select("user_id").distinct(), "user_id", "left_anti")
    after = others.select(*cols).unionByName(live).unionByName(stay)
    statuses = done.filter("status <> 'live'").select(F.col("n").alias("request_id"), "status")
    free = saves.filter(named.isNull()).select(F.col("n").alias("request_id"), F.lit("created").alias("status"))
    none = asked.filter(empty).select(F.col("n").alias("request_id"), F.lit("empty").alias("status"))
    lost = asked.filter((F.col("action") == "unsave") & F.col("target").isNull()).select(F.col("n").alias("request_id"), F.lit("not_found").alias("status"))
    return after, statuses.unionByName(free).unionByName(none).unionByName(lost)


def arrays(elements: DataFrame) -> DataFrame:
    """(user_id, n_saved, saved): each user's array as JSON text, for output."""
    one = F.struct("batch", "ts", "n", F.to_json("element").alias("e"))
    rows = elements.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("l"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]"))
    return rows.select("user_id", F.size("l").alias("n_saved"), joined.alias("saved"))
