"""Queries that run the source scans (SRC-1, 3, 10, 11, 12, 15, 16, 18, 28, 29) over feeds, pages and payloads made of the items.

Each captured document holds the items of twenty consecutive ids, so that its size does not grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import feeds, pages, payloads
from . import fixtures as X
from .registry import query

_PER = 20
_ID = "CAST(id AS VARCHAR(20))"
#: page, place in it, and the item
_BASE = f"it AS (SELECT CAST(floor(id / {_PER}) AS BIGINT) AS page, id % {_PER} AS j, id, lang, published_at FROM items), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS pos FROM it)"


def _documents(spark, d, part: Column, glue: str, head: str, tail: str) -> DataFrame:
    """source_id and body: the parts of twenty items, in order of id, between head and tail."""
    rows = X.items(spark, d).select(F.floor(F.col("id") / _PER).alias("source_id"), "id", part.alias("part"))
    parts = rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), glue).alias("parts"))
    return parts.select("source_id", F.concat(F.lit(head), "parts", F.lit(tail)).alias("body"))


_text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
_id = lambda: F.col("id").cast("string")
_address = lambda: (F.col("id") % 15).cast("string")
_time = lambda: F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _feeds(spark, d) -> DataFrame:
    item = _text("<item>", F.when(F.col("id") % 6 == 5, "").otherwise(_text("<title>Entry &lt;b&gt;", _id(), "&lt;/b&gt;</title>")), "<link>/n/", _address(), "?utm_source=feed</link>",
                 F.when(F.col("published_at").isNotNull(), _text("<pubDate>", _time(), "</pubDate>")).otherwise(""), "<category>", F.col("lang"), "</category><description>about ", F.col("lang"), "</description></item>")
    out = _documents(spark, d, item, "", "<rss><channel><title>Feed</title>", "</channel></rss>")
    return out.withColumn("base_url", _text("https://host.example/feed", F.col("source_id").cast("string")))


_FEED = f"""{_BASE}, f AS (SELECT *, concat('https://host.example/n/', CAST(id % 15 AS VARCHAR)) AS url FROM o WHERE id % 6 <> 5)"""
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, url ORDER BY pos) AS k FROM {}) WHERE k = 1"


@query("feed_scan", X.WITH + f", {_FEED} SELECT page AS source_id, pos, concat('Entry ', {_ID}) AS title, url, epoch(published_at) AS at, concat('about ', lang) AS summary FROM ({_FIRST.format('f')})")
def feed_scan(spark, d):
    return feeds.scan_feed(_feeds(spark, d)).select("source_id", "pos", "title", "url", F.unix_timestamp("published_at").cast("double").alias("at"), "summary")


@query("feed_scan_categories", X.WITH + f", {_FEED} SELECT page AS source_id, pos, url FROM ({_FIRST.format('(SELECT * FROM f WHERE lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'de' + chr(39) + '))')})")
def feed_scan_categories(spark, d):
    return feeds.scan_feed(_feeds(spark, d), include=["en", "de", "fr"], exclude=["fr"]).select("source_id", "pos", "url")


@query("feed_sniff", X.WITH + f", {_BASE} SELECT page AS source_id, count(*) AS entries, count(*) FILTER (WHERE id % 6 <> 5) AS valid, page % 3 < 2 AND 2 * count(*) FILTER (WHERE id % 6 <> 5) >= count(*) AND count(*) FILTER (WHERE id % 6 <> 5) > 0 AS feed FROM o GROUP BY page")
def feed_sniff(spark, d):
    # one page in three neither says by its type that it is a feed nor has a root that does
    k = F.col("source_id") % 3
    rows = _feeds(spark, d).withColumn("content_type", F.when(k == 0, "application/rss+xml").otherwise("text/plain"))
    rows = rows.withColumn("body", F.when(k == 2, F.replace(F.replace("body", F.lit("<rss>"), F.lit("<list>")), F.lit("</rss>"), F.lit("</list>"))).otherwise(F.col("body")))
    return feeds.is_feed(rows)


def _release(key: str = "html_url") -> Column:
    return F.to_json(F.struct(
        _text("v", _id()).alias("name"), _text("https://code.example/r/", _address()).alias(key), (F.col("id") % 5 == 0).alias("draft"), (F.col("id") % 7 == 1).alias("prerelease"),
        _time().alias("published_at"), _text("## Notes\n**fast** [doc](https://a.example) ", F.col("lang")).alias("body"),
    ))


_RELEASES = "{}, f AS (SELECT *, concat('https://code.example/r/', CAST(id % 15 AS VARCHAR)) AS url FROM o WHERE id % 5 <> 0{})"


@query("release_scan", X.WITH + ", " + _RELEASES.format(_BASE, " AND id % 7 <> 1") + f" SELECT page AS source_id, pos, concat('v', {_ID}) AS title, url, epoch(published_at) AS at FROM ({_FIRST.format('f')})")
def release_scan(spark, d):
    rows = _documents(spark, d, _release(), ",", "[", "]")
    return payloads.scan_releases(rows).select("source_id", "pos", "title", "url", F.unix_timestamp("published_at").cast("double").alias("at"))


@query("release_scan_prereleases", X.WITH + ", " + _RELEASES.format(_BASE, "") + f" SELECT page AS source_id, pos, url FROM ({_FIRST.format('f')})")
def release_scan_prereleases(spark, d):
    return payloads.scan_releases(_documents(spark, d, _release(), ",", "[", "]"), prereleases=True).select("source_id", "pos", "url")


# the API refuses one source in three for its rate and gives no answer of use to another; every source has a feed beside it
_FALLBACK = f"""{_BASE}, p AS (SELECT page, count(*) AS n FROM o GROUP BY page), f AS (SELECT o.*, page % 3 = 1 AS limited, id % 7 = 1 AS pre, concat('https://code.example/', CASE WHEN page % 3 = 1 THEN 'a/' ELSE 'r/' END, CAST(id % 15 AS VARCHAR)) AS url FROM o WHERE page % 3 <> 2 AND (page % 3 = 1 OR id % 5 <> 0 AND pos < 12)),
l AS (SELECT *, row_number() OVER (PARTITION BY page, url ORDER BY pos) AS k FROM f WHERE limited OR NOT pre), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS turn FROM l WHERE k = 1)"""


@query(
    "release_fallback",
    X.WITH + f""", {_FALLBACK} SELECT page AS source_id, CASE WHEN limited THEN concat('v', {_ID}, CASE WHEN pre THEN '-RC1' ELSE '' END) ELSE concat('v', {_ID}) END AS title, url, CAST(epoch(published_at) AS BIGINT) AS at, CASE WHEN limited THEN concat('v', {_ID}) END AS tag, CASE WHEN limited THEN 'atom_rate_limit' END AS fallback FROM b WHERE NOT (limited AND (turn > 12 OR pre))""",
)
def release_fallback(spark, d):
    k = F.col("source_id") % 3
    api = _documents(spark, d, _release(), ",", "[", "]").select("source_id", F.when(k == 1, True).when(k == 2, False).alias("rate_limited"), F.when(k == 2, '{"message":"gone"}').otherwise(F.col("body")).alias("body"))
    entry = _text("<entry><title>v", _id(), F.when(F.col("id") % 7 == 1, "-RC1").otherwise(""), '</title><link rel="alternate" href="/a/', _address(), '"/>', F.when(F.col("published_at").isNotNull(), _text("<updated>", _time(), "</updated>")).otherwise(""), "</entry>")
    atoms = _documents(spark, d, entry, "", '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>").withColumn("base_url", F.lit("https://code.example/releases.atom"))
    out = payloads.release_items(api, atoms, most=12)
    return out.select("source_id", "title", "url", F.unix_timestamp("published_at").alias("at"), "tag", "fallback")


def _article() -> Column:
    """The time is ISO text, epoch milliseconds or epoch seconds, by id."""
    seconds = F.unix_timestamp("published_at").cast("string")
    k = F.col("id") % 3
    when = F.when(F.col("published_at").isNull(), "null").when(k == 0, _text('"', _time(), '"')).when(k == 1, _text(seconds, "000")).otherwise(seconds)
    return _text('{"headline":"  Story  ', _id(), ' ","slug":"', _address(), '","when":', when, ',"intro":"<p>about ', F.col("lang"), '</p>"}')


_STORIES = f"{_BASE}, f AS (SELECT *, concat('https://news.example/s/', CAST(id % 15 AS VARCHAR)) AS url FROM o)"
_STORY = f" SELECT page AS source_id, pos, concat('Story ', {_ID}) AS title, url, epoch(published_at) AS at, concat('about ', lang) AS summary FROM ({_FIRST.format('f')})"


def _public(rows: DataFrame, path: str) -> DataFrame:
    out = payloads.scan_public(rows, path, ["title", "headline"], ["slug"], ["when"], ["intro"], template="https://news.example/s/{}/")
    return out.select("source_id", "pos", "title", "url", F.unix_timestamp("published_at").cast("double").alias("at"), "summary")


@query("public_json_scan", X.WITH + f", {_STORIES}" + _STORY)
def public_json_scan(spark, d):
    return _public(_documents(spark, d, _article(), ",", '{"data":{"list":[', "]}}"), "$.data.list")


@query("embedded_json_scan", X.WITH + f", {_STORIES}" + _STORY)
def embedded_json_scan(spark, d):
    html = _documents(spark, d, _article(), ",", '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"articles":[', "]}}}}</script><body>x</body></html>")
    return _public(payloads.embedded(html.withColumnRenamed("body", "html"), "__NEXT_DATA__"), "$.props.pageProps.data.articles")


def _page(spark, d, part: Column, head: str, tail: str) -> DataFrame:
    rows = _documents(spark, d, part, "\n", head, tail)
    return rows.select(F.col("source_id").alias("page"), _text("https://host.example/p", F.col("source_id").cast("string")).alias("url"), F.col("body").alias("html"))


_DAY = "concat('2024-01-', lpad(CAST({} % 28 + 1 AS VARCHAR), 2, '0'))"


@query(
    "changelog_scan",
    X.WITH
    + f""", {_BASE}, f AS (SELECT page, pos, id, 2 + CAST(floor(pos / 3) AS BIGINT) + pos + 1 AS entry, concat('Change ', {_ID}) AS title, {_DAY.format('(id - pos % 3)')} AS date, concat('what ', lang, ' does') AS summary FROM o),
    k AS (SELECT *, substr(sha256(concat(date, chr(10), lower(title))), 1, 20) AS key FROM f) SELECT page, entry, title, date, summary, key, concat('https://host.example/p', CAST(page AS VARCHAR), '?entry=', key) AS link FROM k""",
)
def changelog_scan(spark, d):
    day = _text("2024-01-", F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))
    # ids are consecutive from 0 on, so a page's places follow from them
    part = _text(F.when(F.col("id") % _PER % 3 == 0, _text("<h2>", day, "</h2>")).otherwise(""), "<h3>Change ", _id(), "</h3><p>what <b>", F.col("lang"), "</b> does</p>")
    return pages.changelog(_page(spark, d, part, "<html><h1>Log</h1>", "</html>"))


_LINKS = f"{_BASE}, f AS (SELECT page, pos, id % 4 = 3 AS off, id, concat(CASE WHEN id % 4 = 3 THEN 'https://other.example/n/' ELSE 'https://host.example/n/' END, CAST(id % 15 AS VARCHAR)) AS url, CASE WHEN id % 9 = 0 THEN 'ad' ELSE concat('Headline ', {_ID}) END AS title FROM o)"
_GOOD = "(SELECT * FROM f WHERE title <> 'ad' AND NOT off AND NOT contains(title, '7'))"


def _linked(spark, d) -> DataFrame:
    site = F.when(F.col("id") % 4 == 3, "//other.example").otherwise("")
    title = F.when(F.col("id") % 9 == 0, "ad").otherwise(_text("Headline ", _id()))
    return _page(spark, d, _text('<li><a href="', site, "/n/", _address(), '">', title, "</a></li>"), "<ul>", "</ul>")


@query("link_scan", X.WITH + f", {_LINKS} SELECT page, title, url AS link FROM ({_FIRST.format(_GOOD)})")
def link_scan(spark, d):
    return pages.scan_links(_linked(spark, d), include=["Headline"], exclude=["7"]).select("page", "title", "link")


@query(
    "structure_score",
    X.WITH
    + f""", {_LINKS}, g AS ({_FIRST.format("(SELECT * FROM f WHERE title <> 'ad')")}), n AS (SELECT page, least(count(DISTINCT url), count(DISTINCT title)) AS n FROM g GROUP BY page)
    SELECT page, n, CASE WHEN n >= 4 THEN 'ready' WHEN n >= 2 THEN 'partial' ELSE 'needs_configuration' END AS status, CAST(round(least(0.9, 0.68 + 0.04 * n) * 100) AS BIGINT) AS percent FROM n""",
)
def structure_score(spark, d):
    out = pages.structure_score(_linked(spark, d))
    return out.select("page", "n", "status", F.round(F.col("confidence") * 100).cast("long").alias("percent"))
