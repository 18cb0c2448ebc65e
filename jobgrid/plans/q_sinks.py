"""Sink queries: each writes into the shared folder and reads the result
back, so the check covers the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrid.operators import merge, search
from jobgrid.operators import normalize as N
from jobgrid.plans.catalog import register
from jobgrid.plans.q_landing import _ALL_CTES, _EXPECTED, landing
from jobgrid.plans.q_listings import _KEPT
from jobgrid.plans.q_scalars import _HITS
from jobgrid.session import scratch_path
from jobgrid.sources import fixtures as fx
from jobgrid.sources import snapshot as snap
from jobgrid.sources.landing import source_config

EXPORTED = ("Naukri", "Indeed", "LinkedIn")  # the sources that dump their run as JSON
_EXPORT_COLS = [c for c in N.LISTING_COLUMNS if c != "scraped_at"]


@register(
    "sink_json_export",
    f"SELECT {', '.join(_EXPORT_COLS)} FROM ("
    + " UNION ALL ".join(f"({_EXPECTED[s]})" for s in EXPORTED)
    + ") u",
    ("listings",),
    _ALL_CTES,
)
def sink_json_export(spark, d):
    lnd, cfg = landing(spark, d), source_config(spark)
    recs = N.unify(*[N.normalize(lnd, s, cfg)[0] for s in EXPORTED]).select(*_EXPORT_COLS)
    path = scratch_path(spark, "export")
    snap.export_json(recs, path)
    return snap.read_json_export(spark, path, recs.schema)


@register(
    "sink_search_log",
    """SELECT r.q AS query, h.results, strftime(r.ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' SEARCH query="' || r.q
              || '" results=' || CAST(h.results AS varchar) AS line
       FROM requests r JOIN hits h ON r.q = h.q WHERE r.action = 'search' AND r.q <> ''""",
    ("listings", "requests"),
    {"hits": _HITS},
)
def sink_search_log(spark, d):
    log = fx.requests(spark, d).filter((F.col("action") == "search") & (F.col("q") != ""))
    hits = search.query_hits(fx.listings(spark, d), log)
    path = scratch_path(spark, "searchlog")
    snap.append_search_log(log.join(hits, "q"), path)
    return snap.read_search_log(spark, path).select("query", "results", "line")


@register("sink_snapshot", _KEPT, ("listings",))
def sink_snapshot(spark, d):
    kept = merge.dedupe_keep_first(fx.listings(spark, d))
    root = scratch_path(spark, "snapshot")
    v = snap.write_snapshot(kept, root)
    return snap.read_snapshot(spark, root, v)
