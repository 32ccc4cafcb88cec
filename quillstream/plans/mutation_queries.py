"""Manual changes as queries: batches of changes made from the test tables, applied to the items and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domains as D
from ..operators import mutations as M
from . import fixtures as X
from .registry import query


@query("set_favorite", X.WITH + "SELECT i.id, CASE WHEN e.uid IS NULL THEN i.favorite ELSE e.value END AS favorite FROM items i LEFT JOIN (SELECT user_id AS uid, arg_max(event_id % 2 = 0, event_id) AS value FROM events GROUP BY user_id) e ON i.id = e.uid")
def set_favorite(spark, d):
    changes = X.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 0).alias("value"))
    return M.set_flag(X.items(spark, d), changes, "favorite").select("id", "favorite")


@query("batch_read_affected", X.WITH + "SELECT count(*) FILTER (WHERE i.id IS NOT NULL) AS affected, count(*) FILTER (WHERE i.id IS NULL) AS missing FROM orders o LEFT JOIN items i ON o.o_custkey = i.id")
def batch_read_affected(spark, d):
    return M.affected(X.items(spark, d), X.table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


_TAGS = X.pick(D.TOPICS, "doc_id"), X.pick(D.TOPICS, "doc_id * 5 + 3")


@query(
    "review_tags_ordered",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat_ws(',', " + ", ".join(f"CASE WHEN '{t}' IN ({_TAGS[0]}, {_TAGS[1]}) THEN '{t}' END" for t in D.TOPICS) + ") END AS tags FROM documents",
)
def review_tags_ordered(spark, d):
    raw = F.array(F.expr(_TAGS[0]), F.expr(_TAGS[1]), F.when(F.col("doc_id") % 10 == 0, "unknown").otherwise(F.expr(_TAGS[0])))
    return X.table(spark, d, "documents").select("doc_id", F.array_join(M.ordered_tags(raw, D.TOPICS), ",").alias("tags"))


@query(
    "switch_sources",
    X.WITH + """, c AS (SELECT *, id % 3 <> 0 AS wanted, CASE WHEN id % 3 <> 0 AND lifecycle = 'candidate' THEN 'candidate' WHEN id % 3 <> 0 AND implementation = 'needs_custom_collector' THEN 'needs_custom_collector' END AS refused FROM sources)
    SELECT id, CASE WHEN refused IS NULL THEN wanted ELSE enabled END AS enabled, CASE WHEN refused IS NOT NULL THEN lifecycle WHEN wanted THEN 'active' ELSE 'paused' END AS lifecycle, refused FROM c""",
)
def switch_sources(spark, d):
    rows = X.sources(spark, d)
    changes = rows.select("id", F.lit(1).alias("seq"), (F.col("id") % 3 != 0).alias("enabled"))
    return M.switch_sources(rows, changes).select("id", "enabled", "lifecycle", "refused")


_CHANGE = {
    "id": "user_id", "seq": "event_id", "verification_status": "CASE WHEN event_id % 3 = 0 THEN 'official_linked' WHEN event_id % 9 = 1 THEN 'media_only' END",
    "review_status": "CASE WHEN event_id % 4 = 1 THEN 'approved' WHEN event_id % 4 = 2 THEN 'rejected' WHEN event_id % 20 = 3 THEN 'perhaps' END",
    "origin_publisher": "CASE WHEN event_id % 5 = 0 THEN concat('  Press   ', CAST(event_id % 7 AS VARCHAR(20)), ' ') WHEN event_id % 55 = 1 THEN '  ' END",
}
_CHANGES = f"c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CHANGE.items())} FROM events)"


@query(
    "review_audit",
    X.WITH + f""", {_CHANGES}, ok AS (SELECT c.id, seq, c.verification_status AS v, c.review_status AS r, trim(replace(origin_publisher, '   ', ' ')) AS p, i.verification_status AS iv, i.review_status AS ir FROM c JOIN items i ON i.id = c.id WHERE coalesce(c.review_status, '') <> 'perhaps' AND coalesce(trim(origin_publisher), 'x') <> '')
    SELECT id AS item_id, seq, """
    + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND {until}), {own}) AS {name}_{n}" for name, until in (("old", "1 PRECEDING"), ("new", "CURRENT ROW")) for c, own, n in (("v", "iv", "verification"), ("r", "ir", "review"), ("p", "NULL", "publisher")))
    + " FROM ok",
)
def review_audit(spark, d):
    """Many changes of the same items, some of them invalid."""
    none = {"manual_primary_type": "string", "manual_topic_tags": "array<string>", "manual_industry_tags": "array<string>", "official_url": "string"}
    empty = lambda *names: [F.lit(None).cast(none.get(c, "string")).alias(c) for c in names]
    changes = X.table(spark, d, "events").selectExpr(*[f"{e.replace('VARCHAR(20)', 'STRING')} AS {n}" for n, e in _CHANGE.items()]).select("*", *empty(*none))
    store = X.items(spark, d).select("id", "verification_status", "review_status", F.lit(False).alias("verification_manually_set"), F.lit(False).alias("review_manually_set"), *empty(*none, "origin_publisher"))
    _, audit = M.review(store, changes)
    field = lambda side, c: F.get_json_object(f"{side}_data", f"$.{c}")
    return audit.select("item_id", "seq", *[field(side, c).alias(f"{side}_{n}") for side in ("old", "new") for c, n in (("verification_status", "verification"), ("review_status", "review"), ("origin_publisher", "publisher"))])
