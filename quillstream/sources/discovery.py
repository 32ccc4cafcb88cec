"""Source discovery: how an address may be read, as a ranked union of candidates over captured responses.

A code host's repository, a feed at the address itself, feeds that its page links, feeds at common paths, and lists
in the page's structure are tried in this order.  All candidates of all addresses are one table; they meet the
captured responses in one join, each response is read once, and the candidate of the lowest rank that holds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.upsert import checkpointed
from . import dom, feeds

# Paths, list structures, names that are no owners, and words, paths and regions that hold no items.
COMMON_PATHS = ("/feed", "/rss", "/atom.xml", "/feed.xml")
STRUCTURES = (".news-list li", ".article-list li", ".post-list article", ".posts article", "main article", "h3")
RESERVED = ("collections", "events", "features", "login", "marketplace", "new", "organizations", "orgs", "search", "settings", "sponsors", "topics", "users")
NO_TITLES = ("登录", "注册", "联系我们", "关于我们", "友情链接", "login", "register", "contact", "privacy")
NO_PATHS = ("/login", "/register", "/about", "/contact", "/privacy", "/links")
REGIONS = ("nav", "footer", "header", "aside")
REGION_NAMES = ("footer", "header", "sidebar", "nav", "menu")
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
ALTERNATES = 4  #: linked feeds that are tried of a page
OWNER = r"(?!.*--)[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"
REPOSITORY = r"[A-Za-z0-9_.-]{1,100}"

RESULT = ("source_id", "collector", "url", "status", "confidence", "needs_custom", "selector", "prefix", "found", "reason")


def repository_page(url: Column) -> Column:
    """owner/name of a canonical address that is a repository or its releases page, else null."""
    path, plain = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY")).isNull()
    form = rf"^/({OWNER})/({REPOSITORY}?)(?:\.git)?(?:/(?i:releases))?/?$"
    owner, name = F.regexp_extract(path, form, 1), F.regexp_extract(path, form, 2)
    return F.when(plain & (owner != "") & ~name.isin("", ".", "..") & ~F.lower(owner).isin(*RESERVED), F.concat_ws("/", owner, name))


def _found(rows: DataFrame, collector: str, status: Column, confidence: Column, reason: str, url: str = "url", selector: Column | None = None, prefix: Column | None = None, n: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "source_id", F.lit(collector).alias("collector"), F.col(url).alias("url"), status.alias("status"), confidence.cast("double").alias("confidence"), F.lit(collector == "custom").alias("needs_custom"),
        (none if selector is None else selector).alias("selector"), (none if prefix is None else prefix).alias("prefix"), (F.lit(0) if n is None else n).cast("int").alias("found"), F.lit(reason).alias("reason"),
    )


def _custom(rows: DataFrame, status: str, reason: str, url: str = "url") -> DataFrame:
    return _found(rows, "custom", F.lit(status), F.lit(0.0), reason, url)


def alternates(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page, rank from 0, address: the first distinct feeds that a page links."""
    linked = dom.matches(nodes, 'link[rel~="alternate"][href]').filter(F.lower(F.element_at("attrs", "type")).isin(*FEED_TYPES)).select("page", "pre", F.element_at("attrs", "href").alias("href"))
    rows = linked.join(pages.select("page", F.col("url").alias("page_url")), "page").select("page", "pre", U.canonical_url(F.col("href"), F.col("page_url")).alias("address")).filter("address IS NOT NULL")
    rows = rows.groupBy("page", "address").agg(F.min("pre").alias("pre"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("pre")) - 1).filter(F.col("rank") < ALTERNATES).select("page", "rank", "address")


def item_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page, pre, title, url of the links on a page's own host that may be items, outside menus, heads and feet."""
    names = F.lower(F.concat_ws(" ", F.element_at("attrs", "id"), F.element_at("attrs", "class")))
    apart = reduce(Column.__or__, [F.contains(names, F.lit(w)) for w in REGION_NAMES], F.col("tag").isin(*REGIONS))
    regions = nodes.filter("tag IS NOT NULL").filter(F.coalesce(apart, F.lit(False))).select(F.col("page").alias("_p"), F.col("pre").alias("_lo"), F.col("post").alias("_hi"))
    links = dom.matches(nodes, "a[href]").join(regions, (F.col("page") == F.col("_p")) & (F.col("pre") >= F.col("_lo")) & (F.col("pre") <= F.col("_hi")), "left_anti")
    links = checkpointed(links.select("page", "pre", "post", F.element_at("attrs", "href").alias("href")))
    rows = links.join(dom.texts(links, nodes), ["page", "pre"]).join(pages.select("page", F.col("url").alias("page_url")), "page")
    rows = rows.select("page", "pre", F.col("text").alias("title"), U.canonical_url(F.col("href"), F.col("page_url")).alias("url"), U.host(F.col("page_url")).alias("host"))
    low, path = F.lower("title"), F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")))
    bad = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in NO_TITLES] + [F.contains(path, F.lit(w)) for w in NO_PATHS])
    return rows.filter((F.length("title") >= 4) & F.col("url").isNotNull() & (U.host(F.col("url")) == F.col("host")) & ~bad).select("page", "pre", "title", "url")


def structures(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page, turn, selector, prefix, found of each page with a list: the first of STRUCTURES with two items that differ in
    title and address, else (turn null) the path that most of at least three links share."""
    links = checkpointed(item_links(nodes, pages))
    scopes = reduce(DataFrame.unionByName, [dom.matches(nodes, s).select("page", F.col("pre").alias("scope"), F.col("pre").alias("lo"), F.col("post").alias("hi"), F.lit(i).alias("turn"), (F.col("tag") == "a").alias("own")) for i, s in enumerate(STRUCTURES)])
    scopes = checkpointed(scopes)
    inside = dom.first_inside(scopes.select("page", "scope", "lo", "hi").distinct(), nodes, {"anchor": "a[href]"})
    chosen = scopes.join(inside, ["page", "scope"], "left").select("page", "turn", F.when(F.col("own"), F.col("scope")).otherwise(F.col("anchor.pre")).alias("pre"))
    lists = chosen.join(links, ["page", "pre"]).groupBy("page", "turn").agg(F.least(F.count_distinct("url"), F.count_distinct(F.lower("title"))).cast("int").alias("found")).filter("found >= 2")
    lists = lists.groupBy("page").agg(F.min_by(F.struct("turn", "found"), "turn").alias("x")).select("page", "x.*")
    paths = links.select("page", F.try_parse_url("url", F.lit("PATH")).alias("path")).distinct().withColumn("first", F.regexp_extract("path", "^/+([^/]+)", 1))
    shared = paths.groupBy("page", "first").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.sum("n").alias("all"), F.max(F.when(F.col("first") != "", F.struct("n", "first"))).alias("top"))
    shared = shared.filter("all >= 3 AND top.n >= 3 AND top.n >= 0.6 * all").select("page", F.concat(F.lit("/"), "top.first", F.lit("/")).alias("prefix"), F.col("top.n").cast("int").alias("shared"))
    each = F.array(*[F.lit(s) for s in STRUCTURES])
    both = lists.join(shared, "page", "full")
    return both.select("page", "turn", F.get(each, F.col("turn")).alias("selector"), F.when(F.col("turn").isNull(), F.col("prefix")).alias("prefix"), F.coalesce("found", "shared").alias("found"))


def discover(requests: DataFrame, captured: DataFrame) -> DataFrame:
    """RESULT of requests(source_id, url) over captured(url, final_url, http_status, content_type, body).

    One row a request; source_id must be a long.  captured holds one response an address (in canonical form; of repeated
    ones the smallest by status, address and body counts); an address without one, or with a status outside 200 to 299,
    cannot be read.  status is ready, partial, blocked, unreachable or needs_custom_collector; an invalid address is unreachable."""
    asked = requests.select("source_id", F.col("url").alias("given"), U.canonical_url("url").alias("url"))
    answers = captured.groupBy(F.col("url").alias("address")).agg(F.min(F.struct("http_status", "final_url", "content_type", "body")).alias("a")).select("address", "a.*")
    asked = asked.withColumns({"host": F.coalesce(U.host(F.col("url")), F.lit("")), "repository": repository_page(F.col("url"))})
    coded = F.col("host").isin("github.com", "www.github.com")
    out = [
        _found(asked.filter(coded & F.col("repository").isNotNull()).withColumn("url", F.concat(F.lit("https://github.com/"), "repository", F.lit("/releases"))), "github_release", F.lit("ready"), F.lit(0.99), "repository"),
        _custom(asked.filter(coded & F.col("repository").isNull()), "needs_custom_collector", "no repository"),
        _custom(asked.filter("url IS NULL"), "unreachable", "no address", "given"),
    ]
    read = checkpointed(asked.filter(~coded & F.col("url").isNotNull()).select("source_id", "url").join(answers, F.col("url") == F.col("address"), "left").drop("address"))
    fine = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    out.append(_custom(read.filter("http_status = 403"), "blocked", "refused"))
    out.append(_custom(read.filter(~fine & ~F.col("http_status").eqNullSafe(403)), "unreachable", "no response"))
    read = read.filter(fine).withColumn("final", F.coalesce(U.canonical_url("final_url"), F.col("url")))
    html = F.coalesce(F.contains(F.lower("content_type"), F.lit("html")), F.lit(False)) | F.coalesce(F.ltrim(F.lower(F.substring("body", 1, 1000))).rlike("<html|<!doctype html"), F.lit(False))
    read = checkpointed(read.withColumn("html", html))

    pages = read.filter("html").select(F.col("source_id").alias("page"), F.col("final").alias("url"), F.col("body").alias("html"))
    nodes = dom.nodes(pages)
    origin = F.regexp_extract("final", r"^(https?://[^/?#]+)", 1)
    direct = read.select("source_id", F.lit(-1).alias("rank"), F.col("url").alias("address"))
    linked = alternates(nodes, pages).select(F.col("page").alias("source_id"), "rank", "address")
    paths = F.explode(F.array(*[F.struct(F.lit(ALTERNATES + i).alias("rank"), F.lit(p).alias("path")) for i, p in enumerate(COMMON_PATHS)]))
    common = read.filter("html").select("source_id", origin.alias("origin"), paths.alias("x")).select("source_id", "x.rank", F.concat("origin", "x.path").alias("address"))
    candidates = checkpointed(reduce(DataFrame.unionByName, [direct, linked, common]))
    tried = answers.filter(F.col("http_status").between(200, 299)).join(candidates.select("address").distinct(), "address", "left_semi")
    tried = tried.withColumn("final", F.coalesce(U.canonical_url("final_url"), F.col("address")))
    good = feeds.is_feed(tried.select(F.col("address").alias("source_id"), F.col("final").alias("base_url"), "content_type", "body")).filter("feed").select(F.col("source_id").alias("address"))
    met = candidates.join(good.join(tried.select("address", "final"), "address"), "address")
    chosen = checkpointed(met.groupBy("source_id").agg(F.min_by(F.struct("rank", "final"), "rank").alias("x")).select("source_id", "x.*"))
    out.append(_found(chosen.filter("rank < 0"), "rss", F.lit("ready"), F.lit(0.98), "feed itself", "final"))
    out.append(_found(chosen.filter("rank >= 0"), "rss", F.lit("ready"), F.lit(0.92), "feed of the page", "final"))

    rest = read.join(chosen.select("source_id"), "source_id", "left_anti")
    out.append(_custom(rest.filter("NOT html"), "needs_custom_collector", "neither feed nor page"))
    left = pages.join(chosen.select(F.col("source_id").alias("page")), "page", "left_anti")
    lists = structures(left, nodes.join(left.select("page"), "page", "left_semi"))
    listed = checkpointed(left.select("page", "url").join(lists, "page", "left").withColumnRenamed("page", "source_id"))
    n = F.col("found")
    out.append(_found(listed.filter("turn IS NOT NULL"), "html_list", F.when(n >= 4, "ready").otherwise("partial"), F.least(F.lit(0.9), 0.68 + n * 0.04), "list", selector=F.col("selector"), n=n))
    out.append(_found(listed.filter("turn IS NULL AND prefix IS NOT NULL"), "html_list", F.lit("partial"), F.lit(0.66), "links of one path", prefix=F.col("prefix"), n=n))
    out.append(_custom(listed.filter("turn IS NULL AND prefix IS NULL"), "needs_custom_collector", "no list"))
    return reduce(DataFrame.unionByName, out)
