"""Query of source discovery (SRC-27): sites of five items each, every outcome of the cascade among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import discovery as D
from . import fixtures as X
from .registry import query
from .scan_queries import _id, _text

_SITES = "g AS (SELECT CAST(floor(id / 5) AS BIGINT) AS source_id, count(*) AS n, count(*) FILTER (WHERE id % 7 <> 3) AS good, count(*) FILTER (WHERE id % 2 = 1) AS odd FROM items GROUP BY ALL), k AS (SELECT *, source_id % 12 AS kind, concat('https://s', CAST(source_id AS VARCHAR), '.example') AS site FROM g)"
# kind: what the site holds
#  0 a repository          3 a linked feed beside one at a common path   6 links of one path   9 no response
#  1 a reserved owner      4 a feed at a common path beside a list       7 plain text         10 links in a menu
#  2 a feed                5 a list                                      8 a refusal          11 a feed with few titles
_RESULT = """CASE WHEN kind = 0 THEN 'github_release' WHEN kind IN (2, 3, 4) OR kind = 11 AND odd * 2 >= n THEN 'rss' WHEN kind = 5 AND good >= 2 OR kind = 6 AND good >= 3 THEN 'html_list' ELSE 'custom' END"""


@query(
    "source_discovery",
    X.WITH + f""", {_SITES}, r AS (SELECT *, {_RESULT} AS collector FROM k) SELECT source_id, collector,
    CASE WHEN kind = 0 THEN concat('https://github.com/owner-', CAST(source_id AS VARCHAR), '/name.x/releases') WHEN kind = 1 THEN 'https://www.github.com/Topics/x' WHEN kind = 3 THEN concat(site, '/news.atom') WHEN kind = 4 THEN concat(site, '/rss') WHEN kind IN (5, 6, 10) THEN concat(site, '/moved') ELSE concat(site, '/list') END AS url,
    CASE WHEN collector IN ('github_release', 'rss') THEN 'ready' WHEN kind = 5 AND good >= 2 THEN CASE WHEN good >= 4 THEN 'ready' ELSE 'partial' END WHEN collector = 'html_list' THEN 'partial' WHEN kind = 8 THEN 'blocked' WHEN kind = 9 THEN 'unreachable' ELSE 'needs_custom_collector' END AS status,
    CAST(CASE collector WHEN 'github_release' THEN 99 WHEN 'rss' THEN CASE WHEN kind IN (3, 4) THEN 92 ELSE 98 END WHEN 'html_list' THEN CASE WHEN kind = 5 THEN least(90, 68 + 4 * good) ELSE 66 END ELSE 0 END AS BIGINT) AS percent, collector = 'custom' AS needs_custom,
    CASE WHEN kind = 5 AND collector = 'html_list' THEN '.article-list li' END AS selector, CASE WHEN kind = 6 AND collector = 'html_list' THEN '/n/' END AS prefix, CAST(CASE WHEN collector = 'html_list' THEN good ELSE 0 END AS INTEGER) AS found FROM r""",
)
def source_discovery(spark, d):
    out = D.discover(*_sites(spark, d))
    return out.select("source_id", "collector", "url", "status", F.round(F.col("confidence") * 100).cast("long").alias("percent"), "needs_custom", "selector", "prefix", "found")


def _sites(spark, d):
    """requests and captured responses."""
    source = F.floor(F.col("id") / 5)
    title = F.when(F.col("id") % 7 == 3, F.lit("no")).otherwise(_text("Headline ", _id()))
    item = _text("<li><a href='/n/", _id(), "?utm_source=q'>", title, "</a><a href='/n/x'>read more</a>")
    entry = _text("<item>", F.when((source % 12 == 11) & (F.col("id") % 2 == 0), F.lit("")).otherwise(_text("<title>", title, "</title>")), "<link>/n/", _id(), "</link></item>")
    rows = X.items(spark, d).select(source.alias("source_id"), F.struct("id", item.alias("item"), _text("<a href='n/", _id(), "'>", title, "</a>").alias("link"), entry.alias("entry")).alias("x")).groupBy("source_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda f: F.array_join(F.transform("x", lambda x: x[f]), "")
    kind, name = F.col("source_id") % 12, F.col("source_id").cast("string")
    rows = rows.select("source_id", kind.alias("kind"), _text("https://s", name, ".example").alias("site"), part("item").alias("items"), part("link").alias("links"), _text("<rss><channel><title>F</title>", part("entry"), "</channel></rss>").alias("feed"))
    asked = F.when(F.col("kind") == 0, _text("https://GitHub.com/owner-", name, "/name.x.git")).when(F.col("kind") == 1, F.lit("https://www.github.com/Topics/x")).otherwise(F.concat("site", F.lit("/list/#top")))
    links = '<html><head><link rel="alternate" type="text/html" href="/feed"><link rel="alternate" type="application/rss+xml" href="/missing"><link rel="x alternate" type="Application/Atom+XML" href="news.atom?utm_medium=a"></head>'
    body = (
        F.when(F.col("kind").isin(2, 11), F.col("feed")).when(F.col("kind") == 3, _text(links, "<ul class='news-list'>", F.col("items"), "</ul>")).when(F.col("kind") == 4, _text(" <!DOCTYPE html><ul class='news-list'>", F.col("items"), "</ul>"))
        .when(F.col("kind") == 5, _text("<html><ul class='big article-list'>", F.col("items"), "</ul>")).when(F.col("kind") == 6, _text("<html><a href=/n/7>Contact us</a><div>", F.col("links"), "<a href='https://o.example/n/1'>Elsewhere</a></div>"))
        .when(F.col("kind") == 10, _text("<html><ul class='news-list' id=TopMenu>", F.col("items"), "</ul>")).otherwise(F.lit("plain"))
    )
    response = lambda rows, path, final, status, kind, body: rows.select(F.concat("site", F.lit(path)).alias("url"), F.concat("site", F.lit(final)).alias("final_url"), status.cast("int").alias("http_status"), F.lit(kind).alias("content_type"), body.alias("body"))
    main = rows.filter("kind NOT IN (0, 1, 9)")
    moved = F.col("kind").isin(5, 6, 10)
    captured = response(main.filter(~moved), "/list", "/list", F.when(F.col("kind") == 8, 403).otherwise(200), None, body).unionByName(response(main.filter(moved), "/list", "/moved/", F.lit(200), "text/html; charset=utf-8", body))
    for of, path, status in ((3, "/news.atom", 200), (3, "/feed", 200), (4, "/feed", 404), (4, "/rss", 206), (4, "/feed.xml", 200)):
        captured = captured.unionByName(response(rows.filter(F.col("kind") == of), path, path, F.lit(status), "text/plain", F.col("feed")))
    return rows.select("source_id", asked.alias("url")), captured
