"""JSON payload scans over captured responses: releases, public lists, embedded page data.

Rows of one payload may change a field's type, so payloads are read as variants, never by an inferred schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from . import feeds


def items_of(payloads: DataFrame, path: str = "$", column: str = "body") -> DataFrame:
    """payloads(source_id, body) exploded to source_id, pos, item; an unreadable payload has no items."""
    parsed = payloads.select("source_id", F.try_variant_get(F.try_parse_json(F.col(column)), path, "array<variant>").alias("list"))
    return parsed.select("source_id", F.posexplode("list").alias("pos", "item"))


def field(item: Column, *paths: str) -> Column:
    """The first of some paths that has a text."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(item, f"$.{p}", "string")), F.lit("")) for p in paths])


def flag(item: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "boolean"), F.lit(False))


def any_time(item: Column, *paths: str) -> Column:
    """Epoch seconds, epoch milliseconds or text, told apart by form and size."""
    raw = field(item, *paths)
    n = F.when(raw.rlike(r"^\d{9,14}$"), F.try_to_number(raw, F.lit("9" * 14)).cast("long"))
    return F.coalesce(F.when(n >= 100_000_000_000, D.from_epoch(n, "ms")).otherwise(D.from_epoch(n, "s")), D.parse_known(raw))


def first_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id", key).orderBy("pos"))).filter("k = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).filter(F.col("k") <= most).drop("k")


def scan_public(payloads: DataFrame, path: str, title: list[str], link: list[str], date: list[str], summary: list[str] = ("summary",), template: str | None = None, max_items: int = 50) -> DataFrame:
    """Items with a title and a valid address; template holds {} where the link field goes."""
    item = F.col("item")
    value = field(item, *link)
    address = F.concat(F.lit(template.split("{}")[0]), value, F.lit(template.split("{}")[1])) if template else value
    rows = items_of(payloads, path).select("source_id", "pos", T.collapse(field(item, *title)).alias("title"), U.canonical_url(address).alias("url"), any_time(item, *date).alias("published_at"), T.strip_tags(field(item, *summary)).alias("summary"))
    return first_of(rows.filter("title is not null and url is not null"), "url", max(1, min(200, max_items)))


def scan_releases(payloads: DataFrame, prereleases: bool = False, summary_chars: int = 500) -> DataFrame:
    """Published releases: no drafts, prereleases on request, markdown stripped from the body."""
    item = F.col("item")
    rows = items_of(payloads).filter(~flag(item, "draft"))
    if not prereleases:
        rows = rows.filter(~flag(item, "prerelease"))
    rows = rows.select("source_id", "pos", field(item, "name", "tag_name").alias("title"), U.canonical_url(field(item, "html_url")).alias("url"), any_time(item, "published_at", "created_at").alias("published_at"), T.bounded(T.strip_markdown(field(item, "body")), max(50, min(5000, summary_chars))).alias("summary"), field(item, "tag_name").alias("tag"), flag(item, "prerelease").alias("prerelease"))
    return first_of(rows.filter("title is not null and url is not null"), "url", 200)


#: Titles that read like those of prereleases (fixed values).
PRERELEASE = r"(?i)(?:^|[.\-_ ])(?:alpha|beta|preview|pre|rc)\d*(?:$|[.\-_ ])"


def release_items(api: DataFrame, atoms: DataFrame, prereleases: bool = False, most: int = 30, summary_chars: int = 500) -> DataFrame:
    """Releases of each source, from its API's response or, where that was refused for its rate, from its Atom feed.

    api(source_id, rate_limited, body) and atoms(source_id, base_url, body) hold one row a source; a feed is read only
    for sources whose API was limited (null: it was not).  A feed does not say what is a prerelease, its titles do.
    `fallback` names the way of the rows that came from a feed; at most `most` (1 to 100) a source."""
    most = max(1, min(100, most))
    limited = F.coalesce("rate_limited", F.lit(False))
    head = F.to_json(F.slice(F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"), 1, most))
    own = scan_releases(api.filter(~limited).select("source_id", head.alias("body")), prereleases, summary_chars).withColumn("fallback", F.lit(None).cast("string"))
    read = feeds.scan_feed(atoms.join(api.filter(limited).select("source_id"), "source_id", "left_semi"), max_items=most)
    read = read.withColumns({"tag": F.col("title"), "prerelease": F.col("title").rlike(PRERELEASE), "fallback": F.lit("atom_rate_limit")})
    return own.unionByName(read if prereleases else read.filter("NOT prerelease"))


def embedded(pages: DataFrame, script_id: str) -> DataFrame:
    """The JSON text of a page's data script, as a payload."""
    found = F.regexp_extract("html", rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return pages.select("source_id", F.nullif(found, F.lit("")).alias("body"))


_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def _decoded(inner: Column) -> Column:
    """The text of a JSON string's inside; null if it is none or empty."""
    return F.nullif(F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>")[0], F.lit(""))


def title_links(pages: DataFrame, title_key: str, link_key: str, template: str | None = None, limit: int = 100) -> DataFrame:
    """pages(source_id, html) -> source_id, pos, title, link of the pairs that JSON-like data in a page holds.

    The two keys may stand in either order within 3,000 characters; pairs with the title first come first.  A later
    pair of the same title replaces the link, and no pair counts once `limit` titles are found.  template holds
    {value} where the link field goes; keys are plain text."""
    plain = F.replace(F.coalesce("html", F.lit("")), F.lit('\\"'), F.lit('"'))
    title, link = rf'"\Q{title_key}\E":{_STRING}', rf'"\Q{link_key}\E":(?:{_STRING}|(\d+))'
    gap = r".{0,3000}?"
    forward, reverse = f"(?s){title}{gap}{link}", f"(?s){link}{gap}{title}"

    def pairs(pattern: str, t: int, s: int, n: int) -> Column:
        whole = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        part = lambda m, i: F.regexp_extract(m, pattern, i)
        return F.transform(whole, lambda m: F.struct(_decoded(part(m, t)).alias("title"), F.coalesce(_decoded(part(m, s)), F.nullif(part(m, n), F.lit(""))).alias("link")))

    rows = pages.select("source_id", F.posexplode(F.concat(pairs(forward, 1, 2, 3), pairs(reverse, 3, 1, 2))).alias("pos", "x")).select("source_id", "pos", "x.*")
    rows = rows.filter("title is not null and link is not null")
    same = Window.partitionBy("source_id", "title").orderBy("pos")
    before = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", (F.row_number().over(same) == 1).cast("int")).withColumn("found", F.coalesce(F.sum("new").over(before), F.lit(0))).filter(F.col("found") < limit)
    value = F.max_by("link", "pos")
    return rows.groupBy("source_id", "title").agg(F.min("pos").alias("pos"), (F.replace(F.lit(template), F.lit("{value}"), value) if template else value).alias("link")).select("source_id", "pos", "title", "link")


def scan_indexed(payloads: DataFrame, template: str, max_items: int = 20) -> DataFrame:
    """Articles of payloads(source_id, body) that are one flat array whose members point at each other by index.

    The first object whose `datalist` leads to an object gives the articles; pointers are followed one step.  template
    holds {} where an article's number goes, for articles without an address.  Repeated numbers and articles without
    a number or a title are passed over."""
    kind = F.schema_of_variant

    def follow(value: Column) -> Column:
        at = F.try_variant_get(value, "$", "int")
        return F.when(kind(value) == "BIGINT", F.coalesce(F.when(at >= 0, F.get("list", at)), value)).otherwise(value)

    rows = payloads.select("source_id", F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>").alias("list"))
    rows = rows.select("source_id", "list", F.posexplode("list").alias("at", "channel"))
    rows = rows.withColumn("refs", F.try_variant_get(follow(F.try_variant_get("channel", "$.datalist", "variant")), "$", "array<variant>")).filter("refs is not null")
    rows = rows.withColumn("articles", F.filter(F.transform("refs", follow), lambda a: F.startswith(kind(a), F.lit("OBJECT")))).filter(F.size("articles") > 0)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("at"))).filter("k = 1")
    rows = rows.select("source_id", "list", F.posexplode("articles").alias("pos", "article"))

    def value(name: str, *kinds: str) -> Column:
        found = follow(F.try_variant_get("article", f"$.{name}", "variant"))
        return F.when(kind(found).isin(*kinds), F.try_variant_get(found, "$", "string"))

    number = lambda name: F.when(value(name, "BIGINT", "STRING").rlike(r"^\d*[1-9]\d*$"), value(name, "BIGINT", "STRING"))
    address = F.nullif(F.regexp_replace(T.collapse(value("url", "STRING")), r"[?&]type=\w+", ""), F.lit(""))
    own = F.replace(F.lit(template), F.lit("{}"), F.col("aid"))
    rows = rows.select("source_id", "pos", number("aid").alias("aid"), T.collapse(value("title", "STRING")).alias("title"), D.from_epoch(F.try_to_number(number("dateline"), F.lit("9" * 14)).cast("long"), "s").alias("published_at"), address.alias("address"))
    rows = rows.filter("aid is not null and title <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id", "aid").orderBy("pos"))).filter("k = 1")
    rows = rows.withColumn("url", U.canonical_url(F.coalesce("address", own))).filter("url is not null")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).filter(F.col("k") <= max(1, min(200, max_items)))
    return rows.select("source_id", "pos", "title", "url", "published_at", "aid")
