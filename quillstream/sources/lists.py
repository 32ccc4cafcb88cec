"""Lists of items on captured pages: selector lists, filtered links with nearby dates, hubs, paged walks.

All take pages(page, url, html), parse each page once (sources/dom.py) and do the rest as joins by page and
interval, so that any number of pages, each of bounded size, is one job.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..operators.upsert import checkpointed
from . import dom, payloads

# Words that no item's title has, endings of addresses that are no items, and dates near a link.
EXCLUDED = ("登录", "注册", "联系我们", "关于我们", "成员介绍", "组织架构", "活动日历", "招聘", "login", "register", "contact us")
ASSETS = (".7z", ".avi", ".css", ".gif", ".jpeg", ".jpg", ".js", ".mov", ".mp3", ".mp4", ".pdf", ".png", ".rar", ".svg", ".webp", ".zip")
DATE = r"(?:19|20)\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}(?:\s*日)?"
NEARBY = ".summary, .description, .desc, p"
STOPS = ("main", "body", "html")
ITEMS = "page long, pos int, title string, url string, published_at timestamp, time_text string, summary string, link_type string"


@dataclass(frozen=True)
class ListConfig:
    """How a list page is read; see config() for defaults and bounds."""

    mode: str = "link_filter"
    max_pages: int = 20
    max_depth: int = 1
    max_items: int = 1000
    allowed_domains: tuple = ()
    allow_subdomains: bool = False
    include_text: tuple = ()
    exclude_text: tuple = EXCLUDED
    include_url: tuple = ()
    exclude_url: tuple = ()
    keep_query_params: tuple | None = None
    item_selector: str | None = None
    title_selector: str | None = None
    link_selector: str | None = None
    date_selector: str | None = None
    ancestor_date_selector: str | None = None
    summary_selector: str | None = None
    pagination_selector: str | None = None
    embedded_title_key: str | None = None
    embedded_link_key: str | None = None
    embedded_link_template: str | None = None
    filter_selector_items: bool = False


def config(root: dict) -> ListConfig:
    """A source's configuration: values of a wrong kind count as absent, numbers are brought into their bounds."""
    part = lambda k: root.get(k) if isinstance(root.get(k), dict) else {}
    discovery, extraction = part("discovery"), part("extraction")
    text = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    number = lambda v, default: v if isinstance(v, int) and not isinstance(v, bool) else default
    within = lambda v, lo, hi: max(lo, min(v, hi))
    strings = lambda v: tuple(x.strip() for x in v if isinstance(x, str) and x.strip()) if isinstance(v, (list, tuple)) else ()
    flag = lambda v: v if isinstance(v, bool) else False
    mode = text(discovery.get("mode")) or text(root.get("mode")) or "link_filter"
    if mode not in ("selectors", "link_filter"):
        raise ValueError("mode must be selectors or link_filter")
    if mode == "selectors" and not text(extraction.get("item_selector")):
        raise ValueError("selectors mode needs extraction.item_selector")
    selectors = {f.name: text(extraction.get(f.name)) for f in fields(ListConfig) if f.name.endswith(("_selector", "_key", "_template")) and f.name != "pagination_selector"}
    return ListConfig(
        mode, within(number(discovery.get("max_pages"), 20), 1, 100), within(number(discovery.get("max_depth"), 1), 0, 3), within(number(discovery.get("max_items"), number(root.get("max_items"), 1000)), 1, 10_000),
        tuple(d.lower().lstrip(".") for d in strings(root.get("allowed_domains"))), flag(root.get("allow_subdomains")), strings(discovery.get("include_text")), strings(discovery.get("exclude_text")) or EXCLUDED,
        strings(discovery.get("include_url_patterns")), strings(discovery.get("exclude_url_patterns")), strings(root["keep_query_params"]) if root.get("keep_query_params") is not None else None,
        pagination_selector=text(discovery.get("pagination_selector")), filter_selector_items=flag(root.get("filter_selector_items")), **selectors,
    )


def _any(text: Column, parts) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p.lower())) for p in parts], F.lit(False))


def allowed(url: Column, page_url: Column, c: ListConfig) -> Column:
    """The address stands on a domain of the list, the page's own by default."""
    host = F.coalesce(U.host(url), F.lit(""))
    if not c.allowed_domains:
        own = U.host(page_url)
        return (host == own) | (F.endswith(host, F.concat(F.lit("."), own)) if c.allow_subdomains else F.lit(False))
    each = [(host == d) | (F.endswith(host, F.lit(f".{d}")) if c.allow_subdomains else F.lit(False)) for d in c.allowed_domains]
    return reduce(Column.__or__, each)


def usable(url: Column, c: ListConfig) -> Column:
    low = F.lower(url)
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return ~reduce(Column.__or__, [F.endswith(path, F.lit(a)) for a in ASSETS]) & ~_any(low, c.exclude_url)


def titled(title: Column, url: Column, c: ListConfig, include: bool) -> Column:
    """Four characters with a letter, none of the excluded words, and where it is asked for one of the included words or parts of addresses."""
    low = F.lower(title)
    ok = (F.length(title) >= 4) & title.rlike(r"[A-Za-z\x{3400}-\x{9fff}]") & ~_any(low, c.exclude_text)
    if include and (c.include_text or c.include_url):
        ok = ok & (_any(low, c.include_text) | _any(F.lower(url), c.include_url))
    return F.coalesce(ok, F.lit(False))


def _bounded(rows: DataFrame, order: list[str], limit: int, *keep: str) -> DataFrame:
    """The first rows of each page."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("page").orderBy(*order))).filter(F.col("_k") <= limit).drop("_k")


def _resolved(rows: DataFrame, pages: DataFrame, href: Column, c: ListConfig) -> DataFrame:
    """rows with the page's address and their own in canonical form."""
    own = rows.join(pages.select("page", F.col("url").alias("page_url"), *[F.col(x) for x in ("collected_at",) if x in pages.columns]), "page")
    keep = None if c.keep_query_params is None else list(c.keep_query_params)
    return own.withColumn("url", U.canonical_url(href, F.col("page_url"), keep))


def _finish(rows: DataFrame, pages: DataFrame) -> DataFrame:
    now = F.col("collected_at") if "collected_at" in pages.columns else F.lit(None).cast("timestamp")
    kind = F.when(U.host(F.col("page_url")) == U.host(F.col("url")), "same_site").otherwise("external")
    return rows.select("page", F.col("scope").alias("pos"), "title", "url", D.parse_datetime(F.col("time_text"), now).alias("published_at"), "time_text", "summary", kind.alias("link_type"))


def _nearest(scopes: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """page, scope, near: of the closest ancestor with such a node inside, the first of them; no ancestor above main, body or html counts."""
    up = nodes.filter("tag IS NOT NULL").select(F.col("page").alias("_p"), F.col("pre").alias("u_lo"), F.col("post").alias("u_hi"), F.col("depth").alias("u_depth"), F.col("tag").alias("u_tag"))
    above = scopes.select("page", "scope", "lo").join(up, (F.col("page") == F.col("_p")) & (F.col("u_lo") < F.col("lo")) & (F.col("lo") <= F.col("u_hi"))).drop("_p")
    floor = above.groupBy("page", "scope").agg(F.max(F.when(F.col("u_tag").isin(*STOPS), F.col("u_depth"))).alias("floor"))
    above = above.join(floor, ["page", "scope"]).filter("floor IS NULL OR u_depth >= floor")
    found = dom.matches(nodes, selector).select(F.col("page").alias("_p"), "pre", "post", F.element_at("attrs", "href").alias("href"))
    met = above.join(found, (F.col("page") == F.col("_p")) & (F.col("pre") > F.col("u_lo")) & (F.col("pre") <= F.col("u_hi")))
    return met.groupBy("page", "scope").agg(F.min_by(F.struct("pre", "post", "href"), F.struct(-F.col("u_depth"), F.col("pre"))).alias("near"))


def selector_items(pages: DataFrame, c: ListConfig, nodes: DataFrame | None = None) -> DataFrame:
    """ITEMS of each page by its item selector: at most max_items a page, in the page's order.

    The link is the one that link_selector names, else the item itself if it is one, else the first inside; without
    an address of its own it is looked up by title in the data inside the page's scripts.  The date is the one
    inside, else that of the nearest group around the item."""
    nodes = dom.nodes(pages) if nodes is None else nodes
    picked = dom.matches(nodes, c.item_selector).select("page", F.col("pre").alias("scope"), F.col("pre").alias("lo"), F.col("post").alias("hi"), (F.col("tag") == "a").alias("is_a"), F.element_at("attrs", "href").alias("own"))
    picked = checkpointed(picked)
    chosen = {"title": c.title_selector, "link": c.link_selector, "anchor": "a[href]", "date": c.date_selector, "brief": c.summary_selector}
    rows = dom.first_inside(picked, nodes, {f: s for f, s in chosen.items() if s}).join(picked.drop("lo", "hi"), ["page", "scope"])
    empty = F.lit(None).cast("struct<pre:int,post:int,href:string>")
    for f, s in chosen.items():
        rows = rows if s else rows.withColumn(f, empty)
    ends = picked.select("page", "scope", F.struct(F.col("lo").alias("pre"), F.col("hi").alias("post"), F.col("own").alias("href")).alias("self"))
    rows = rows.join(ends, ["page", "scope"]).withColumn("link", F.coalesce("link", F.when(F.col("is_a"), F.col("self")), "anchor")).withColumn("title", F.coalesce("title", "link"))
    if c.ancestor_date_selector:
        rows = rows.join(_nearest(picked, nodes, c.ancestor_date_selector), ["page", "scope"], "left")
    else:
        rows = rows.withColumn("near", empty)
    rows = dom.with_texts(rows, nodes, "title", "date", "near", "brief")
    href = F.col("link.href")
    if c.embedded_title_key and c.embedded_link_key:
        known = payloads.title_links(pages.select(F.col("page").alias("source_id"), "html"), c.embedded_title_key, c.embedded_link_key, c.embedded_link_template or "{value}")
        known = known.groupBy(F.col("source_id").alias("page"), F.col("title").alias("title_text")).agg(F.max("link").alias("known"))
        rows, href = rows.join(known, ["page", "title_text"], "left"), F.coalesce(href, F.col("known"))
    rows = _resolved(rows, pages, href, c).withColumn("title", F.col("title_text"))
    good = F.col("url").isNotNull() & allowed(F.col("url"), F.col("page_url"), c) & usable(F.col("url"), c) & titled(F.col("title"), F.col("url"), c, c.filter_selector_items)
    rows = rows.filter(good).withColumn("time_text", F.coalesce(F.nullif("date_text", F.lit("")), "near_text")).withColumn("summary", F.col("brief_text"))
    return _finish(_bounded(rows, ["scope"], c.max_items), pages)


def link_items(pages: DataFrame, c: ListConfig, nodes: DataFrame | None = None) -> DataFrame:
    """ITEMS of each page from all its links that pass the filters.

    A date is looked for in the link's text, then in those of the two elements around it; a summary beside the link."""
    nodes = dom.nodes(pages) if nodes is None else nodes
    links = dom.matches(nodes, "a[href]").select("page", F.col("pre").alias("scope"), F.struct("pre", "post", F.element_at("attrs", "href").alias("href")).alias("link"), "parent")
    up = lambda level, of: nodes.select(F.col("page").alias("_p"), F.col("pre").alias("_pre"), F.struct("pre", "post", F.lit(None).cast("string").alias("href")).alias(level), F.col("parent").alias(f"{level}_parent"))
    for level, of in (("up1", "parent"), ("up2", "up1_parent")):
        links = links.join(up(level, of), (F.col("page") == F.col("_p")) & (F.col(of) == F.col("_pre")), "left").drop("_p", "_pre")
    links = _resolved(checkpointed(links), pages, F.col("link.href"), c)
    links = links.filter(F.col("url").isNotNull() & allowed(F.col("url"), F.col("page_url"), c) & usable(F.col("url"), c))
    around = links.filter("up1 IS NOT NULL").select("page", F.col("up1.pre").alias("scope"), F.col("up1.pre").alias("lo"), F.col("up1.post").alias("hi")).distinct()
    near = dom.first_inside(around, nodes, {"near": NEARBY}).select(F.col("page").alias("_p"), F.col("scope").alias("_s"), "near")
    links = links.join(near, (F.col("page") == F.col("_p")) & (F.col("up1.pre") == F.col("_s")), "left").drop("_p", "_s")
    rows = dom.with_texts(links, nodes, "link", "up1", "up2", "near").withColumn("title", F.col("link_text"))
    rows = rows.filter(titled(F.col("title"), F.col("url"), c, True))
    found = [F.nullif(F.regexp_extract(F.coalesce(F.col(f), F.lit("")), DATE, 0), F.lit("")) for f in ("link_text", "up1_text", "up2_text")]
    brief = F.when((F.col("near_text") != F.col("title")) & (F.length("near_text") > 8), F.col("near_text"))
    rows = rows.withColumn("time_text", F.coalesce(*found)).withColumn("summary", brief)
    return _finish(_bounded(rows, ["scope"], c.max_items), pages)


def list_items(pages: DataFrame, c: ListConfig, nodes: DataFrame | None = None) -> DataFrame:
    return selector_items(pages, c, nodes) if c.mode == "selectors" else link_items(pages, c, nodes)


def case_hub(pages: DataFrame, c: ListConfig) -> DataFrame:
    """The items of a list as cases."""
    return list_items(pages, c).withColumn("record_kind", F.lit("case"))


def document_hub(pages: DataFrame, selectors: dict[str, str], max_items: int = 20) -> DataFrame:
    """Reports and the cases inside them: page, pos, record_kind, title, url, published_at, summary, fingerprint, parent_fingerprint.

    selectors: report_item, case_item, and title, link, date, summary of both with the prefixes report_ and case_.
    An entry needs a title of four characters and a link; without its report a case does not count.  At most
    max_items entries a page, reports before their cases."""
    nodes, found = dom.nodes(pages), []
    scopes = dom.matches(nodes, selectors["report_item"]).select("page", F.col("pre").alias("scope"), F.col("pre").alias("lo"), F.col("post").alias("hi"))
    scopes = checkpointed(scopes)
    inner = dom.matches(nodes, selectors["case_item"]).select(F.col("page").alias("_p"), F.col("pre").alias("c_lo"), F.col("post").alias("c_hi"))
    cases = scopes.join(inner, (F.col("page") == F.col("_p")) & (F.col("c_lo") > F.col("lo")) & (F.col("c_lo") <= F.col("hi"))).select("page", F.col("lo").alias("report"), F.col("c_lo").alias("scope"), F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"))
    for kind, rows in (("report", scopes.withColumn("report", F.col("scope"))), ("case", checkpointed(cases))):
        chosen = {f: s for f in ("title", "link", "date", "summary") if (s := selectors.get(f"{kind}_{f}"))}
        entries = dom.first_inside(rows, nodes, chosen)
        for f in ("date", "summary"):
            entries = entries if f in chosen else entries.withColumn(f, F.lit(None).cast("struct<pre:int,post:int,href:string>"))
        entries = dom.with_texts(entries, nodes, "title", "date", "summary")
        entries = _resolved(entries, pages, F.col("link.href"), ListConfig()).filter((F.length("title_text") >= 4) & F.col("url").isNotNull())
        entries = entries.join(rows.select("page", "scope", "report"), ["page", "scope"])
        mark = T.fingerprint(T.normalize_text(F.col("title_text")))
        found.append(checkpointed(entries.select("page", "report", "scope", F.lit(kind).alias("record_kind"), F.col("title_text").alias("title"), "url", D.parse_known(F.col("date_text")).alias("published_at"), F.col("summary_text").alias("summary"), mark.alias("fingerprint"))))
    reports, cases = found
    parent = reports.select("page", "report", F.col("fingerprint").alias("parent_fingerprint"))
    both = reports.withColumn("parent_fingerprint", F.lit(None).cast("string")).unionByName(cases.join(parent, ["page", "report"]))
    order = Window.partitionBy("page").orderBy("report", F.col("record_kind") != "report", "scope")
    out = both.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= max(1, min(100, max_items)))
    return out.select("page", "pos", "record_kind", "title", "url", "published_at", "summary", "fingerprint", "parent_fingerprint")


# Topics of posts that are no articles.
NO_ARTICLES = ("课程", "活动", "专题", "直播", "大会", "培训", "招聘")
POST = "struct<aid:string,article_title:string,article_summary:string,publish_time:string,sub_type:string,is_promotion:string,topic:array<struct<name:string>>>"


def paged_posts(captured: DataFrame, base: str, max_pages: int = 3, max_items: int = 30) -> DataFrame:
    """source_id, pos, aid, title, url, published_at, summary of captured(source_id, number, body), pages of a posts list.

    A scan ends before the first page that is absent, no JSON, has a code other than 0 or no posts, and after the first
    with fewer posts than a full one.  Promotions, other kinds of posts, excluded topics and posts without id or title
    are left out; the first post of an id counts."""
    size = min(max(1, min(100, max_items)), 20)
    body = F.from_json("body", f"struct<code:string,data:array<{POST}>>")
    rows = captured.withColumn("b", body).select("source_id", F.col("number").cast("int").alias("number"), F.expr("coalesce(b.code = '0' AND size(b.data) > 0, false)").alias("good"), "b.data", F.size("b.data").alias("n"))
    rows = rows.filter(F.col("number").between(1, max(1, min(5, max_pages))))
    run = Window.partitionBy("source_id").orderBy("number")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("good") & (F.row_number().over(run) == F.col("number")) & F.coalesce(F.bool_and(F.col("good") & (F.col("n") >= size)).over(before), F.lit(True))
    posts = rows.withColumn("open", open_).filter("open").select("source_id", "number", F.posexplode("data").alias("at", "p")).select("source_id", "number", "at", "p.*")
    wanted = F.coalesce(~F.col("sub_type").rlike(r"^-?\d+$"), F.lit(True)) | (F.col("sub_type") == "0")
    wanted = wanted & ~F.coalesce(F.col("is_promotion") == "true", F.lit(False)) & ~F.coalesce(F.exists("topic", lambda t: F.trim(t["name"]).isin(*NO_ARTICLES)), F.lit(False))
    clean = {c: F.nullif(F.trim(c), F.lit("")) for c in ("aid", "article_title", "article_summary")}
    posts = posts.filter(wanted).withColumns(clean).filter("aid IS NOT NULL AND article_title IS NOT NULL")
    first = Window.partitionBy("source_id", "aid").orderBy("number", "at")
    posts = posts.withColumn("k", F.row_number().over(first)).filter("k = 1")
    posts = posts.withColumn("url", U.canonical_url(F.concat(F.lit(base), "aid"))).filter("url IS NOT NULL")
    posts = posts.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("number", "at"))).filter(F.col("pos") <= max(1, min(100, max_items)))
    ms = F.expr("try_cast(publish_time AS double)")
    return posts.select("source_id", "pos", "aid", F.col("article_title").alias("title"), "url", F.when(ms > 0, F.timestamp_millis(ms.cast("long"))).alias("published_at"), F.col("article_summary").alias("summary"))


def walk(items: DataFrame, links: DataFrame, starts: DataFrame, max_pages: int, max_depth: int, max_items: int) -> DataFrame:
    """source_id, pos, item url and the page it comes from, of walks over captured pages with bounds.

    starts: source_id, url; links: source_id, page_url, pos, next_url; items: source_id, page_url, pos, url.  Pages come
    breadth first, each once; a page gives at most as many of its items as are still wanted, of which only new ones
    count; where enough are found, no further page is read or noted.  A source's captured pages meet in one task."""
    part = lambda rows, kind, page, at, url: rows.select("source_id", F.lit(kind).alias("kind"), page.alias("page"), at.cast("int").alias("at"), url.alias("url"))
    all_ = part(starts, "start", F.lit(None).cast("string"), F.lit(0), F.col("url"))
    all_ = all_.unionByName(part(links, "link", F.col("page_url"), F.col("pos"), F.col("next_url"))).unionByName(part(items, "item", F.col("page_url"), F.col("pos"), F.col("url")))
    most, deep, wanted = max(1, min(100, max_pages)), max(0, min(3, max_depth)), max(1, min(10_000, max_items))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        of = {k: {p: g["url"].tolist() for p, g in rows[rows["kind"] == k].groupby("page")} for k in ("link", "item")}
        queue = [(u, 0) for u in rows.loc[rows["kind"] == "start", "url"]][:1]
        noted, read, found = {u for u, _ in queue}, 0, {}
        for url, depth in queue:
            if read >= most or len(found) >= wanted:
                break
            read += 1
            for item in of["item"].get(url, [])[: wanted - len(found)]:
                found.setdefault(item, url)
            if len(found) < wanted and depth < deep:
                for link in of["link"].get(url, []):
                    if link not in noted and len(noted) < most:
                        noted.add(link)
                        queue.append((link, depth + 1))
        text = lambda x: pd.Series(list(x), dtype=object)
        return pd.DataFrame({"source_id": [rows["source_id"].iloc[0]] * len(found), "pos": range(len(found)), "url": text(found), "page_url": text(found.values())})

    return all_.groupBy("source_id").applyInPandas(run, "source_id long, pos int, url string, page_url string")


# Dates and years of changelogs, and words that say that something was done.
FULL_DATE = r"((?:19|20)\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?"
YEAR = r"(?:19|20)\d{2}"
ACTION = "发布|上线|升级|更新|新增|开源|退役|下线|降价|支持|修复|优化"


@dataclass(frozen=True)
class ChangelogConfig:
    """Where the entries of a dated changelog stand; cells count from 0 in a table's row."""

    date_heading_selector: str
    entry_selector: str
    content_selector: str | None = None
    entry_title_selector: str | None = None
    entry_date_selector: str | None = None
    entry_summary_selector: str | None = None
    entry_title_cells: tuple = ()
    entry_date_cell: int | None = None
    entry_summary_cell: int | None = None
    entry_link_cell: int | None = None
    include_entry_terms: tuple = ()
    exclude_entry_terms: tuple = ()
    entry_title_replacements: dict | None = None
    append_summary_when_title_lacks_action: bool = False
    max_items: int = 20


def dated(raw: Column, context: Column) -> Column:
    """The full date in a text, else the text; a text without a year takes that of the heading above it."""
    year = F.nullif(F.regexp_extract(context, YEAR, 0), F.lit(""))
    text = F.coalesce(F.nullif(raw, F.lit("")), context, F.lit(""))
    text = F.when(~text.rlike(YEAR) & year.isNotNull(), F.concat(year, F.lit("年"), text)).otherwise(text)
    return F.coalesce(F.nullif(F.regexp_extract(text, FULL_DATE, 0), F.lit("")), text)


def dated_entries(pages: DataFrame, c: ChangelogConfig) -> DataFrame:
    """page, pos, title, url, published_at, summary, key, time_text and detail_link of a changelog's entries.

    The last date heading holds for the entries after it, until the next; table rows name their cells.  The first entry
    of each key, a hash of date and title, counts."""
    nodes = dom.nodes(pages)
    span = lambda s: dom.matches(nodes, s).select("page", F.col("pre").alias("scope"), F.col("pre").alias("lo"), F.col("post").alias("hi"))
    heads, entries = span(c.date_heading_selector).withColumn("head", F.lit(True)), span(c.entry_selector).withColumn("head", F.lit(False))
    both = entries.join(heads.select("page", "scope"), ["page", "scope"], "left_anti").unionByName(heads)
    if c.content_selector:
        root = dom.matches(nodes, c.content_selector).groupBy(F.col("page").alias("_p")).agg(F.min(F.struct("pre", "post")).alias("r"))
        both = both.join(root, (F.col("page") == F.col("_p")) & (F.col("lo") > F.col("r.pre")) & (F.col("lo") <= F.col("r.post"))).drop("_p", "r")
    node = lambda x: F.struct(F.col(f"{x}lo").alias("pre"), F.col(f"{x}hi").alias("post"), F.lit(None).cast("string").alias("href"))
    both = checkpointed(both.withColumn("self", node("")))
    rows = dom.with_texts(both, nodes, "self")
    before = Window.partitionBy("page").orderBy("scope").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.last(F.when(F.col("head"), F.col("self_text")), ignorenulls=True).over(before)).filter("NOT head")
    if c.entry_date_cell is None and not c.entry_date_selector:
        rows = rows.filter("heading IS NOT NULL")
    cells = dom.matches(nodes, "th, td").select(F.col("page").alias("_p"), "pre", "post")
    cells = both.filter("NOT head").join(cells, (F.col("page") == F.col("_p")) & (F.col("pre") > F.col("lo")) & (F.col("pre") <= F.col("hi"))).select("page", "scope", F.struct("pre", "post", F.lit(None).cast("string").alias("href")).alias("cell"))
    cells = dom.with_texts(checkpointed(cells), nodes, "cell")
    cells = cells.groupBy("page", "scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", F.col("cell_text").alias("text")))), lambda x: F.nullif(x["text"], F.lit(""))).alias("cells"))
    rows = rows.join(cells, ["page", "scope"], "left")
    chosen = {"title": c.entry_title_selector, "date": c.entry_date_selector, "brief": c.entry_summary_selector}
    chosen = {f: s for f, s in chosen.items() if s}
    if chosen:
        rows = dom.with_texts(rows.join(dom.first_inside(both.filter("NOT head"), nodes, chosen), ["page", "scope"]), nodes, *chosen)
    cell = lambda i: F.get("cells", F.lit(i)) if i is not None and i >= 0 else F.lit(None).cast("string")
    own = lambda f: F.nullif(F.col(f"{f}_text"), F.lit("")) if f in chosen else F.lit(None).cast("string")
    title = F.nullif(F.concat_ws(" — ", *[cell(i) for i in c.entry_title_cells]), F.lit("")) if c.entry_title_cells else own("title")
    rows = rows.withColumn("title", F.coalesce(title, "self_text")).withColumn("raw", cell(c.entry_date_cell) if c.entry_date_cell is not None else own("date"))
    rows = rows.withColumn("summary", cell(c.entry_summary_cell) if c.entry_summary_cell is not None else own("brief"))
    whole = F.lower(F.concat_ws(" ", "title", "summary"))
    rows = rows.filter((F.length("title") >= 4) & ~_any(whole, c.exclude_entry_terms))
    rows = rows.filter(_any(whole, c.include_entry_terms)) if c.include_entry_terms else rows
    if c.append_summary_when_title_lacks_action:
        clause = F.trim(F.split(F.coalesce("summary", F.lit("")), "[。；;\n]")[0])
        add = ~F.col("title").rlike(ACTION) & (clause != "") & ~F.contains(F.lower("title"), F.lower(clause))
        rows = rows.withColumn("title", F.when(add, F.concat("title", F.lit("："), F.substring(clause, 1, 100))).otherwise(F.col("title")))
    for old, new in (c.entry_title_replacements or {}).items():
        rows = rows.withColumn("title", F.replace("title", F.lit(old), F.lit(new)))
    rows = rows.withColumn("date_text", dated(F.col("raw"), F.col("heading")))
    parts = [F.regexp_extract("date_text", FULL_DATE, i).try_cast("int") for i in (1, 2, 3)]
    when = F.coalesce(F.try_make_timestamp(*parts, F.lit(0), F.lit(0), F.lit(0)), D.parse_known(F.col("date_text")))
    key = F.substring(F.sha2(F.lower(F.concat(F.coalesce(F.nullif("date_text", F.lit("")), "heading", F.lit("None")), F.lit("\n"), "title")), 256), 1, 20)
    rows = rows.withColumn("key", key).withColumn("published_at", when)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page", "key").orderBy("scope"))).filter("k = 1")
    rows = _bounded(rows, ["scope"], max(1, min(200, c.max_items)))
    rows = rows.join(pages.select("page", F.col("url").alias("page_url")), "page")
    base = F.regexp_replace(F.col("page_url"), r"#.*$", "")
    url = U.canonical_url(F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("entry="), "key"), keep=None)
    if c.entry_link_cell is not None:
        links = dom.matches(nodes, "a[href]").select(F.col("page").alias("_p"), "pre", F.element_at("attrs", "href").alias("href"))
        spots = dom.matches(nodes, "th, td").select("page", F.col("pre").alias("c_lo"), F.col("post").alias("c_hi"))
        spots = both.filter("NOT head").join(spots, "page").filter("c_lo > lo AND c_lo <= hi").withColumn("n", F.row_number().over(Window.partitionBy("page", "scope").orderBy("c_lo")) - 1).filter(F.col("n") == c.entry_link_cell)
        met = spots.join(links, (F.col("page") == F.col("_p")) & (F.col("pre") > F.col("c_lo")) & (F.col("pre") <= F.col("c_hi")))
        rows = rows.join(met.groupBy("page", "scope").agg(F.nullif(F.trim(F.min_by("href", "pre")), F.lit("")).alias("detail_link")), ["page", "scope"], "left")
    else:
        rows = rows.withColumn("detail_link", F.lit(None).cast("string"))
    return rows.select("page", F.col("scope").alias("pos"), F.substring("title", 1, 500).alias("title"), url.alias("url"), "published_at", F.substring("summary", 1, 2000).alias("summary"), "key", F.coalesce("raw", "heading").alias("time_text"), "detail_link")
