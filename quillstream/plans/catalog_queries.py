"""Queries of catalogue syncs and purges (MUT-7, MUT-8, AGG-5, AGG-6): customers and suppliers stand in for sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domains as D
from ..operators import catalog_sync as S
from ..operators import purge as P
from . import fixtures as X
from .registry import query

_KEY = "CAST(c_custkey AS VARCHAR(20))"
#: The stored sources: one for each customer.  Column: expression for both engines.
_STORED = {
    "id": "c_custkey",
    "slug": f"CASE WHEN c_acctbal < -400 THEN NULL WHEN c_nationkey = 3 THEN concat('legacy-source-', {_KEY}) ELSE concat('shop-', {_KEY}) END",
    "start_url": f"concat('https://s', CAST(c_nationkey AS VARCHAR(20)), '.example/', {_KEY})",
    "lifecycle": "CASE WHEN c_acctbal < 2000 THEN 'candidate' WHEN c_acctbal < 7000 THEN 'active' ELSE 'paused' END",
    "enabled": "c_acctbal BETWEEN 2000 AND 6000",
    "managed": "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "origin": "CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 5000 THEN 'user_added' ELSE 'preset' END",
    "kind": "'formal'",
    "name": "c_name",
    "role": X.pick(D.ROLES, "c_nationkey"),
    "tier": "CASE WHEN c_nationkey < 5 THEN 'government' WHEN c_nationkey < 12 THEN 'association' ELSE 'official_company' END",
    "audience": "CASE WHEN c_acctbal > 4000 THEN 'leadership' ELSE 'all' END",
    "policy": X.pick(D.POLICIES, "c_nationkey"),
    "implementation": X.pick(D.IMPLEMENTATION, "c_nationkey"),
    "homepage_visible": "c_nationkey > 2",
    "export_visible": "c_nationkey > 4",
}
#: Where somebody has changed a row since its last sync.
_EDITED = "c_acctbal BETWEEN 1000 AND 3000"
#: The catalogue's entries: some of the customers, under other slugs and addresses, with other fields, in part.
_WANTED = _STORED | {
    "slug": f"CASE WHEN c_nationkey IN (7, 8) THEN concat('renamed-', {_KEY}) WHEN c_nationkey IN (9, 3) THEN concat('moved-', {_KEY}) WHEN c_nationkey = 11 THEN concat('new-', {_KEY}) ELSE concat('shop-', {_KEY}) END",
    "start_url": f"CASE WHEN c_nationkey IN (9, 11) THEN concat('https://new.example/', {_KEY}) ELSE concat('https://s', CAST(c_nationkey AS VARCHAR(20)), '.example/', {_KEY}) END",
    "lifecycle": "CASE WHEN c_acctbal < 500 OR c_nationkey IN (5, 6) THEN 'active' WHEN c_acctbal < 5000 THEN 'candidate' ELSE 'paused' END",
    "name": "CASE WHEN c_acctbal > 8000 THEN concat(c_name, ' II') ELSE c_name END",
    "position": "c_custkey",
}
_IN_CATALOG = "c_nationkey NOT IN (13, 14, 15) OR c_mktsegment = 'FURNITURE'"
_ALIASED = "c_nationkey = 9"
_HISTORY = "o_orderpriority LIKE '1%' AND o_orderstatus = 'F'"
_SAME = ("slug", "start_url", *S.FIELDS)


def _columns(spec: dict[str, str], *leave: str) -> list[str]:
    return [f"{e} AS {n}" for n, e in spec.items() if n not in leave]


_TABLES = f"""WITH stored AS (SELECT {", ".join(_columns(_STORED))}, {_EDITED} AS edited FROM customer),
wanted AS (SELECT {", ".join(_columns(_WANTED, "id", "enabled", "managed", "origin", "kind"))} FROM customer WHERE {_IN_CATALOG}
UNION ALL SELECT {", ".join(_columns(_WANTED | {"slug": f"concat('second-', {_KEY})", "start_url": f"concat('https://second.example/', {_KEY})", "position": "c_custkey + 100000000"}, "id", "enabled", "managed", "origin", "kind"))} FROM customer WHERE {_ALIASED}),
aliases AS (SELECT {_WANTED["slug"]} AS slug, {_STORED["start_url"]} AS start_url FROM customer WHERE {_ALIASED} UNION ALL SELECT concat('second-', {_KEY}), {_STORED["start_url"]} FROM customer WHERE {_ALIASED})"""


def _decisions(reconcile: bool) -> str:
    """Every entry by its own: the sources it could mean, each looked up by a subquery."""
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM w.{c}" for c in _SAME)
    astray = "(s.lifecycle <> w.lifecycle OR s.enabled <> (w.lifecycle = 'active'))" if reconcile else "FALSE"
    return f"""{_TABLES}, matched AS (SELECT w.*, coalesce((SELECT max(id) FROM stored s WHERE s.slug = w.slug), (SELECT max(id) FROM stored s WHERE s.start_url = w.start_url),
    (SELECT min(s.id) FROM aliases a JOIN stored s ON a.start_url = s.start_url WHERE a.slug = w.slug)) AS id FROM wanted w),
    single AS (SELECT w.*, coalesce(s.managed, FALSE) AS was_managed, CASE WHEN w.id IS NULL THEN 'created' WHEN s.slug IS NOT NULL AND s.slug <> w.slug AND s.slug NOT LIKE 'legacy-source-%' THEN 'conflict'
    WHEN s.managed THEN CASE WHEN {'FALSE' if reconcile else 's.edited'} THEN 'conflict' WHEN {same} AND NOT (s.lifecycle = 'candidate' AND w.lifecycle = 'active') AND NOT {astray} THEN 'existing' ELSE 'updated' END
    WHEN {'TRUE' if reconcile else 'FALSE'} AND s.origin = 'preset' THEN 'updated' ELSE 'conflict' END AS alone FROM matched w LEFT JOIN stored s ON w.id = s.id),
    found AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM single o WHERE o.id = x.id AND o.alone = 'updated' AND o.position < x.position) THEN 'conflict' ELSE alone END AS decision FROM single x)"""


def _after(reconcile: bool) -> str:
    """found and the sources afterwards; those with an order of _HISTORY are used."""
    managed = ", ".join(f"CASE WHEN w.id IS NOT NULL THEN w.{c} ELSE s.{c} END AS {c}" for c in _SAME)
    keep = "FALSE" if reconcile else "s.lifecycle = 'paused'"
    stay = "FALSE" if reconcile else "w.was_managed AND s.lifecycle = 'active' AND w.lifecycle = 'candidate'"
    sweep = "s.origin = 'preset' AND NOT EXISTS (SELECT 1 FROM wanted n WHERE n.slug = s.slug)" if reconcile else "FALSE"
    hide = {"lifecycle": "'paused'", "enabled": "FALSE", "managed": "FALSE", "kind": "'fallback'", "homepage_visible": "FALSE", "export_visible": "FALSE"}
    names = ["id", *_SAME, "lifecycle", "enabled", "managed", "origin", "kind"]
    return f"""{_decisions(reconcile)}, used AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE {_HISTORY}),
    merged AS (SELECT s.id, {managed}, CASE WHEN w.id IS NULL OR {keep} THEN s.lifecycle WHEN {stay} THEN 'active' ELSE w.lifecycle END AS lifecycle, s.enabled AS was_enabled,
    w.id IS NOT NULL AS updated, s.managed OR w.id IS NOT NULL AS managed, CASE WHEN w.id IS NOT NULL THEN 'preset' ELSE s.origin END AS origin, 'formal' AS kind FROM stored s LEFT JOIN (SELECT * FROM found WHERE decision = 'updated') w ON s.id = w.id),
    named AS (SELECT *, CASE WHEN updated THEN lifecycle = 'active' ELSE was_enabled END AS enabled, CASE WHEN {sweep} THEN CASE WHEN EXISTS (SELECT 1 FROM used u WHERE u.id = s.id) THEN 'retired' ELSE 'deleted' END
    WHEN updated THEN 'updated' ELSE 'kept' END AS outcome FROM merged s),
    after AS (SELECT {", ".join(f"CASE WHEN outcome = 'retired' THEN {hide[n]} ELSE {n} END AS {n}" if n in hide else n for n in names)}, outcome FROM named
    UNION ALL SELECT NULL, {", ".join(_SAME)}, lifecycle, lifecycle = 'active', TRUE, 'preset', 'formal', 'created' FROM found WHERE decision = 'created')"""


def _tables(spark, d) -> dict:
    customers = X.table(spark, d, "customer")
    rows = lambda spec, where, *leave: customers.filter(where).selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in _columns(spec, *leave)])
    stored = customers.selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in _columns(_STORED)], f"{_EDITED} AS edited")
    stored = stored.withColumn("mark", F.when(F.col("edited"), "another").otherwise(S.mark())).drop("edited")
    leave = ("id", "enabled", "managed", "origin", "kind")
    second = _WANTED | {"slug": f"concat('second-', {_KEY})", "start_url": f"concat('https://second.example/', {_KEY})", "position": "c_custkey + 100000000"}
    wanted = rows(_WANTED, _IN_CATALOG, *leave).unionByName(rows(second, _ALIASED, *leave))
    aliases = rows({"slug": _WANTED["slug"], "start_url": _STORED["start_url"]}, _ALIASED).unionByName(rows({"slug": second["slug"], "start_url": _STORED["start_url"]}, _ALIASED))
    used = X.table(spark, d, "orders").filter(_HISTORY).select(F.col("o_custkey").alias("id"))
    return {"wanted": wanted, "stored": stored, "aliases": aliases, "used": used}


def _found(spark, d, reconcile: bool):
    t = _tables(spark, d)
    return S.decisions(t["wanted"], t["stored"], reconcile, t["aliases"])


def _synced(spark, d, reconcile: bool):
    t = _tables(spark, d)
    return S.synced(t["wanted"], t["stored"], t["used"], reconcile, t["aliases"])


def _register(name: str, reconcile: bool) -> None:
    @query(f"{name}_decisions", _decisions(reconcile) + " SELECT slug, id, decision FROM found")
    def decided(spark, d):
        return _found(spark, d, reconcile).select("slug", "id", "decision")

    @query(name, _after(reconcile) + " SELECT * FROM after")
    def after(spark, d):
        return _synced(spark, d, reconcile).drop("mark")


_register("catalog_synced", False)
_register("catalog_forced", True)
_STATES = [("lifecycle", s) for s in ("active", "candidate", "paused")] + [("implementation", s) for s in D.IMPLEMENTATION]


@query(
    "catalog_counters",
    _after(True)
    + """ SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'created') AS created, count(*) FILTER (WHERE decision = 'updated') AS updated, count(*) FILTER (WHERE decision = 'existing') AS existing,
    count(*) FILTER (WHERE decision = 'conflict') AS conflicts FROM found) a, (SELECT count(*) FILTER (WHERE outcome = 'deleted') AS deleted, count(*) FILTER (WHERE outcome = 'retired') AS retired, """
    + ", ".join(f"count(*) FILTER (WHERE outcome <> 'deleted' AND {c} = '{s}' AND slug IN (SELECT slug FROM wanted)) AS {s}" for c, s in _STATES)
    + " FROM after) b",
)
def catalog_counters(spark, d):
    return S.counters(_found(spark, d, True), _synced(spark, d, True))


# The documents' sources with their items, which name other sources as those that found them; the runs of suppliers' lines.
_MENTIONS = {"duck": "CASE WHEN summary IS NULL THEN NULL ELSE [length(title) % 20, source_id, length(summary) % 20] END", "spark": "CASE WHEN summary IS NOT NULL THEN array(length(title) % 20, source_id, length(summary) % 20) END"}
_RETIRED_SLUG, _RETIRED_URL = "tier = 'association'", "https://host3.example/"
_PURGE = (
    X.WITH
    + f""", mentioned AS (SELECT i.id AS item_id, i.source_id AS of, unnest(m) AS named, generate_subscripts(m, 1) AS place FROM (SELECT *, {_MENTIONS['duck']} AS m FROM items) i),
    gone AS (SELECT * FROM sources WHERE {_RETIRED_SLUG} OR start_url LIKE '{_RETIRED_URL}%'), acts AS (SELECT e.event_type, i.source_id FROM events e JOIN items i ON e.user_id = i.id)"""
)


def _purge_tables(spark, d) -> dict:
    sources = X.sources(spark, d)
    items = X.items(spark, d).selectExpr("id", "source_id", f"transform({_MENTIONS['spark']}, m -> named_struct('source_id', CAST(m AS BIGINT), 'at', 'list')) AS discoveries")
    urls = sources.filter(F.startswith("start_url", F.lit(_RETIRED_URL))).select(F.concat(F.upper(F.substring("start_url", 1, 8)), F.substring("start_url", 9, 1000), F.lit("/?utm_source=x")).alias("start_url"))
    acts = X.table(spark, d, "events").select(F.col("user_id").alias("item_id"), "event_type")
    return {"sources": sources, "items": items, "executions": X.executions(spark, d), "runs": X.runs(spark, d), "gone": P.retired(sources, sources.filter(_RETIRED_SLUG).select("slug"), urls), "acts": acts}


@query(
    "purge_plan",
    _PURGE
    + """, counted AS (SELECT g.id, g.slug, (SELECT count(*) FROM items i WHERE i.source_id = g.id) AS items, (SELECT count(*) FROM acts WHERE source_id = g.id AND event_type <> 'click') AS revisions,
    (SELECT count(*) FROM acts WHERE source_id = g.id AND event_type = 'click') AS reviews, (SELECT count(*) FROM executions e WHERE e.source_id = g.id) AS executions, (SELECT count(*) FROM mentioned WHERE named = g.id) AS mentions FROM gone g)
    SELECT *, revisions + reviews + mentions AS related FROM counted""",
)
def purge_plan(spark, d):
    t = _purge_tables(spark, d)
    out = P.plan(t["gone"], t["items"], t["executions"], t["acts"].filter("event_type <> 'click'"), t["acts"].filter("event_type = 'click'"))
    return out.select("id", "slug", "items", "revisions", "reviews", "executions", "mentions", "related")


@query(
    "purge_counters",
    _PURGE
    + """ SELECT (SELECT count(*) FROM gone) AS deleted_sources, (SELECT count(*) FROM items WHERE source_id IN (SELECT id FROM gone)) AS deleted_items, (SELECT count(*) FROM executions WHERE source_id IN (SELECT id FROM gone)) AS deleted_executions,
    (SELECT count(*) FROM runs r WHERE r.id IN (SELECT run_id FROM executions WHERE source_id IN (SELECT id FROM gone)) AND r.id NOT IN (SELECT run_id FROM executions WHERE source_id NOT IN (SELECT id FROM gone))) AS deleted_empty_runs,
    (SELECT count(*) FROM mentioned WHERE named IN (SELECT id FROM gone) AND (of NOT IN (SELECT id FROM gone) OR of >= named)) AS cleaned_mentions""",
)
def purge_counters(spark, d):
    t = _purge_tables(spark, d)
    return P.counters(t["sources"], t["items"], t["executions"], t["runs"], t["gone"])


@query(
    "purge_items",
    _PURGE
    + """ SELECT i.id, (SELECT string_agg(CAST(named AS VARCHAR), ',' ORDER BY place) FROM mentioned m WHERE m.item_id = i.id AND named NOT IN (SELECT id FROM gone)) AS discoveries,
    (SELECT count(*) FROM mentioned m WHERE m.item_id = i.id AND named IN (SELECT id FROM gone)) AS removed FROM items i WHERE i.source_id NOT IN (SELECT id FROM gone)""",
)
def purge_items(spark, d):
    t = _purge_tables(spark, d)
    rows = P.purged(t["sources"], t["items"], t["executions"], t["runs"], t["gone"])["items"]
    return rows.select("id", F.array_join(F.transform("discoveries", lambda x: x["source_id"].cast("string")), ",").alias("discoveries"), "removed")
