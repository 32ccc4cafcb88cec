"""HTML scans over captured pages: lists of links, changelogs, and scores of a page's structure."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

NODE = "array<struct<pos:int,kind:string,text:string,href:string>>"
SKIP = {"script", "style", "noscript", "template"}
HEADS = ("h1", "h2", "h3")


class _Nodes(HTMLParser):
    """Links, headings, paragraphs, list items and dates in document order; unclosed tags end where the next begins."""

    KINDS = {"a": "link", "h1": "h1", "h2": "h2", "h3": "h3", "p": "text", "li": "text", "time": "date", "td": "cell", "title": "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag in self.KINDS:
            node = [self.KINDS[tag], [], dict(attrs).get("href")]
            self.nodes.append(node)
            ended = {tag} | ({"p", *HEADS} if tag in (*HEADS, "p", "li", "td") else set())
            self.open = [o for o in self.open if o[0] not in ended] + [(tag, node)]

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        self.open = [o for o in self.open if o[0] != tag]

    def handle_data(self, data):
        if not self.skip:
            for _, node in self.open:
                node[1].append(data)


def parse_nodes(html: str | None) -> list[dict]:
    p = _Nodes()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass
    return [{"pos": i, "kind": k, "text": " ".join("".join(t).split()), "href": h} for i, (k, t, h) in enumerate(p.nodes)]


def _nodes(pages: pd.Series) -> pd.Series:
    return pages.map(parse_nodes)


def nodes(pages: DataFrame) -> DataFrame:
    """pages(page, url, html) -> page, url, pos, kind, text, href."""
    return pages.select("page", "url", F.explode(F.pandas_udf(_nodes, NODE)("html")).alias("n")).select("page", "url", "n.*")


def valid_title(title: Column, include: list[str], exclude: list[str], url: Column | None = None, url_parts: list[str] = ()) -> Column:
    """At least four characters with a letter, none of the excluded texts, one of the included ones if any are asked for."""
    ok = (F.length(title) >= 4) & title.rlike(r"(?U)[A-Za-z\p{IsHan}]")
    for t in exclude:
        ok = ok & ~F.contains(title, F.lit(t))
    wanted = [F.contains(title, F.lit(t)) for t in include] + [F.contains(url, F.lit(p)) for p in url_parts]
    if wanted:
        some = wanted[0]
        for w in wanted[1:]:
            some = some | w
        ok = ok & some
    return ok


def scan_links(pages: DataFrame, include: list[str] = (), exclude: list[str] = (), same_site: bool = True, limit: int = 100) -> DataFrame:
    """Links that may be items, the first of each address on a page."""
    rows = nodes(pages).filter("kind = 'link' and href is not null and not href rlike '^(?i)(javascript|mailto|tel|#)'")
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").rlike("^//"), F.concat(F.lit("https:"), "href")).otherwise(F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.when(F.startswith("href", F.lit("/")), "").otherwise("/"), "href"))
    rows = rows.withColumn("link", U.canonical_url(absolute)).filter("link is not null").filter(~F.col("link").rlike(r"(?i)\.(pdf|png|jpe?g|gif|zip|css|js)$"))
    if same_site:
        rows = rows.filter(U.same_site(F.col("link"), U.host(F.col("url"))))
    rows = rows.filter(valid_title(F.col("text"), list(include), list(exclude), F.col("link")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page", "link").orderBy("pos"))).filter("k = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).filter(F.col("k") <= limit).select("page", "pos", F.col("text").alias("title"), "link")


def changelog(pages: DataFrame, date_pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Entries of single-page changelogs: third-level headings under dated ones, with the text up to the next heading.

    The last date heading is carried forward; an entry's key is 20 hex digits of the hash of date and title."""
    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes(pages).withColumn("d", F.when(F.col("kind") == "h2", F.nullif(F.regexp_extract("text", date_pattern, 1), F.lit(""))))
    rows = rows.withColumn("date", F.last("d", ignorenulls=True).over(order)).withColumn("entry", F.sum(F.col("kind").isin(*HEADS).cast("int")).over(order))
    parts = rows.groupBy("page", "url", "entry").agg(
        F.min_by("kind", "pos").alias("kind"), F.min_by("text", "pos").alias("title"), F.min_by("date", "pos").alias("date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("summary"),
    ).filter("kind = 'h3' and title <> ''")
    key = F.substring(F.sha2(F.concat_ws("\n", F.coalesce("date", F.lit("")), F.lower("title")), 256), 1, 20)
    out = parts.select("page", "entry", "title", "date", F.substring("summary", 1, 2000).alias("summary"), key.alias("key"), F.concat("url", F.lit("?entry="), key).alias("link"))
    return out.withColumn("k", F.row_number().over(Window.partitionBy("page", "key").orderBy("entry"))).filter("k = 1").drop("k")


def structure_score(pages: DataFrame) -> DataFrame:
    """How much a page looks like a list: distinct links and titles, status and confidence."""
    links = scan_links(pages, same_site=False, limit=10_000)
    n = F.least(F.count_distinct("link"), F.count_distinct("title"))
    out = links.groupBy("page").agg(n.alias("n"))
    return out.withColumn("status", F.when(F.col("n") >= 4, "ready").when(F.col("n") >= 2, "partial").otherwise("needs_configuration")).withColumn("confidence", F.least(F.lit(0.9), 0.68 + 0.04 * F.col("n")))


def crawl(start: DataFrame, captured: DataFrame, max_depth: int = 1, max_pages: int = 20) -> DataFrame:
    """Bounded breadth-first walk over captured(url, next_url) from start(url): the frontier of each depth anti-joins what was visited."""
    seen = frontier = start.select("url", F.lit(0).alias("depth"))
    for depth in range(1, max(0, min(3, max_depth)) + 1):
        frontier = captured.join(frontier.select("url"), "url", "left_semi").select(F.col("next_url").alias("url"), F.lit(depth).alias("depth")).distinct().join(seen.select("url"), "url", "left_anti")
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(max(1, min(100, max_pages)))
