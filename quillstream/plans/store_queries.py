"""The item store after two runs (SINK-1, UPS-1 to UPS-8, Q-40, Q-42, STR-5).

In the first run every document is collected once, some at a neighbour's address.  In the second they come again:
some under another address, title or source, some without their summary.  The second engine folds the rows that match
nothing in order, by recursion, and does the rest with windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store as S
from ..operators import upsert as P
from . import fixtures as X
from .registry import query

_HEX = "substr(md5(CAST(id AS {s})), {i}, 1)"
_URL = "concat('https://h.example/', CAST(CASE WHEN {h1} < '4' THEN id >> 1 ELSE id END AS {s}))"
#: expressions of a run's rows, {s} the string type and {h1} to {h5} digits of a hash of the id
_RUNS = [
    {"canonical_url": _URL, "source_id": "source_id", "title": "title", "summary": "summary", "category": "category"},
    {
        "canonical_url": f"CASE WHEN {{h2}} < '3' THEN concat('https://h.example/moved/', CAST(id >> 1 AS {{s}})) ELSE {_URL} END",
        "source_id": "CASE WHEN {h3} < '2' THEN source_id + 1 ELSE source_id END",
        "title": "CASE WHEN {h4} < '4' THEN concat(title, '!') ELSE title END",
        "summary": "CASE WHEN {h5} < '4' THEN NULL ELSE summary END",
        "category": "CASE WHEN {h5} < '8' THEN 'unclassified' ELSE category END",
    },
]
_AT = [1735689600, 1735776000]


def _run(n: int, s: str) -> dict[str, str]:
    digits = {f"h{i}": _HEX.format(s=s, i=i) for i in range(1, 6)}
    fields = {c: e.format(s=s, **digits) for c, e in _RUNS[n].items()}
    return {"seq": f"{n} * 1000000000000 + id", "run_id": str(n + 1)} | fields | {"fingerprint": f"nullif({fields['title'].replace('title', 'lower(title)')}, '')", "published_at": "published_at"}


def _select(n: int, s: str) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in _run(n, s).items())


def batches(spark, d) -> list[DataFrame]:
    rows = X.items(spark, d)
    return [rows.selectExpr(*[f"{e} AS {c}" for c, e in _run(n, "STRING").items()], f"timestamp_seconds({_AT[n]}) AS run_at", "'name' AS source_name") for n in (0, 1)]


def stored(spark, d) -> S.ItemStore:
    store = S.ItemStore(spark, f"{P.shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    for batch in batches(spark, d):
        store.persist(batch)
    return store


_STATE = (
    X.WITH.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", r1 AS (SELECT {_select(0, "VARCHAR")} FROM items), n1 AS ({X.NUMBERED.format(seq="seq", t="r1")}), {X.fold("f1", "n1")},
t1 AS (SELECT r1.*, a.seq AS a_seq, a.source_id AS owner, a.canonical_url AS item_url, a.fingerprint AS a_print FROM r1 JOIN f1 ON f1.seq = r1.seq JOIN r1 a ON a.seq = f1.into_),
s1 AS (SELECT * FROM t1 WHERE seq = a_seq),
r2 AS (SELECT {_select(1, "VARCHAR")} FROM items),
m2 AS (SELECT r2.*, u.owner AS u_owner, u.item_url AS u_url, p.owner AS p_owner, p.item_url AS p_url FROM r2 LEFT JOIN s1 u ON u.item_url = r2.canonical_url LEFT JOIN s1 p ON p.owner = r2.source_id AND p.fingerprint = r2.fingerprint),
n2 AS ({X.NUMBERED.format(seq="seq", t="m2 WHERE u_url IS NULL AND p_url IS NULL")}), {X.fold("f2", "n2")},
a2 AS (SELECT r2.* FROM r2 JOIN f2 ON f2.seq = r2.seq WHERE f2.into_ = f2.seq),
t2 AS (SELECT m2.* EXCLUDE (u_owner, u_url, p_owner, p_url), CASE WHEN u_url IS NOT NULL THEN u_owner WHEN n.seq <= m2.seq THEN n.source_id WHEN p_url IS NOT NULL THEN p_owner ELSE a.source_id END AS owner,
CASE WHEN u_url IS NOT NULL THEN u_url WHEN n.seq <= m2.seq THEN n.canonical_url WHEN p_url IS NOT NULL THEN p_url ELSE a.canonical_url END AS item_url, coalesce(f2.into_ = m2.seq, false) AS born
FROM m2 LEFT JOIN a2 n ON n.canonical_url = m2.canonical_url LEFT JOIN f2 ON f2.seq = m2.seq LEFT JOIN a2 a ON a.seq = f2.into_),
h AS (SELECT *, seq = a_seq AS born FROM (SELECT * EXCLUDE a_print FROM t1) UNION ALL BY NAME SELECT * FROM t2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_url, run_id, source_id ORDER BY seq) AS turn FROM h) WHERE turn = 1),
own AS (SELECT *, lag({{'t': title, 's': summary, 'p': published_at}}) OVER (PARTITION BY item_url ORDER BY seq) AS was, row_number() OVER (PARTITION BY item_url ORDER BY seq DESC) AS back FROM c WHERE source_id = owner),
seen AS (SELECT item_url, source_id, min(run_id) AS a, max(run_id) AS z FROM c WHERE source_id <> owner GROUP BY ALL),
lists AS (SELECT item_url, string_agg(concat(source_id, ':', a, '-', z), ',' ORDER BY source_id) AS found FROM seen GROUP BY item_url)
"""
)
_CHANGED = "(was.t IS DISTINCT FROM title OR was.s IS DISTINCT FROM summary OR was.p IS DISTINCT FROM published_at)"


@query(
    "store_after_two_runs",
    _STATE
    + """SELECT substr(sha256(o.item_url), 1, 32) AS item_id, o.owner AS source_id, o.item_url AS canonical_url, b.fingerprint, o.title, o.summary, CAST(epoch(o.published_at) AS BIGINT) AS published, o.category,
    (SELECT max(run_id) FROM c WHERE c.item_url = o.item_url) AS seen_in, b.run_id AS born_in, coalesce(found, '') AS found FROM own o JOIN h b ON b.item_url = o.item_url AND b.born LEFT JOIN lists ON lists.item_url = o.item_url WHERE back = 1""",
)
def store_after_two_runs(spark, d):
    run = lambda c: F.when(F.unix_timestamp(c) == _AT[0], 1).when(F.unix_timestamp(c) == _AT[1], 2).cast("long")
    found = F.array_join(F.transform("discoveries", lambda x: F.concat(x["source_id"], F.lit(":"), run(x["first_seen_at"]), F.lit("-"), run(x["last_seen_at"]))), ",")
    return stored(spark, d).items().select(
        "item_id", "source_id", "canonical_url", "fingerprint", "title", "summary", F.unix_timestamp("published_at").alias("published"), "category", run("last_seen_at").alias("seen_in"), run("discovered_at").alias("born_in"), found.alias("found")
    )


@query(
    "store_run_counters",
    _STATE
    + f""", k AS (SELECT h.seq, h.run_id, CASE WHEN c.seq IS NULL THEN 'in_batch_duplicate' WHEN c.born THEN 'new' WHEN c.source_id <> c.owner THEN 'skipped' WHEN {_CHANGED} THEN 'updated' ELSE 'skipped' END AS outcome,
    last_value(CASE WHEN c.source_id = c.owner THEN c.category END IGNORE NULLS) OVER (PARTITION BY h.item_url ORDER BY h.seq ROWS UNBOUNDED PRECEDING) AS cat FROM h LEFT JOIN c ON c.seq = h.seq LEFT JOIN own ON own.seq = h.seq)
    SELECT run_id, count(*) FILTER (WHERE outcome = 'new') AS "new", count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome IN ('skipped', 'in_batch_duplicate')) AS duplicate,
    count(*) FILTER (WHERE outcome <> 'in_batch_duplicate' AND cat = 'unclassified') AS unclassified FROM k GROUP BY run_id""".replace("was.t IS DISTINCT FROM title OR was.s IS DISTINCT FROM summary OR was.p IS DISTINCT FROM published_at", "own.was.t IS DISTINCT FROM own.title OR own.was.s IS DISTINCT FROM own.summary OR own.was.p IS DISTINCT FROM own.published_at"),
)
def store_run_counters(spark, d):
    return P.counters(stored(spark, d).outcomes(), "run_id")


@query(
    "store_revisions",
    _STATE
    + f"""SELECT substr(sha256(item_url), 1, 32) AS item_id, run_id, concat_ws(',', CASE WHEN was.t IS DISTINCT FROM title THEN 'title' END, CASE WHEN was.s IS DISTINCT FROM summary THEN 'summary' END, CASE WHEN was.p IS DISTINCT FROM published_at THEN 'published_at' END) AS fields,
    CASE WHEN was.t IS DISTINCT FROM title THEN was.t END AS old_title, CASE WHEN was.p IS DISTINCT FROM published_at THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS new_published FROM own WHERE NOT born AND {_CHANGED}""",
)
def store_revisions(spark, d):
    return stored(spark, d).revisions().select(
        "item_id", "run_id", F.array_join(F.json_object_keys("new_data"), ",").alias("fields"), F.get_json_object("old_data", "$.title").alias("old_title"), F.get_json_object("new_data", "$.published_at").alias("new_published")
    )
