"""RSS and Atom scans over captured documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U

ENTRY = "array<struct<pos:int,title:string,link:string,date:string,summary:string,categories:array<string>>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def parse_feed(xml: str | None) -> list[dict]:
    """Entries in order; an unreadable document has none, an unreadable entry is passed over."""
    try:
        root = ET.fromstring((xml or "").strip().encode())
    except ET.ParseError:
        return []
    out = []
    for pos, node in enumerate(e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        text = lambda *names: next(("".join(c.itertext()).strip() for n in names for c in node if _local(c.tag) == n), None)  # noqa: B023, E731
        link = next((c.get("href") or (c.text or "").strip() for c in node if _local(c.tag) == "link" and c.get("rel", "alternate") == "alternate"), None)
        cats = [(c.get("term") or c.text or "").strip() for c in node if _local(c.tag) == "category"]
        out.append({"pos": pos, "title": text("title"), "link": link, "date": text("pubdate", "published", "updated", "created", "date"), "summary": text("description", "summary", "content"), "categories": cats})
    return out


def _parse(docs: pd.Series) -> pd.Series:
    return docs.map(parse_feed)


def scan_feed(feeds: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_items: int = 1000) -> DataFrame:
    """feeds(source_id, base_url, body) -> source_id, pos, title, url, published_at, summary.

    Entries without a title or a valid link are passed over; the first of a canonical address wins."""
    rows = feeds.select("source_id", "base_url", F.explode(F.pandas_udf(_parse, ENTRY)("body")).alias("e")).select("source_id", "base_url", "e.*")
    if include:
        rows = rows.filter(F.arrays_overlap("categories", F.array(*[F.lit(x) for x in include])))
    if exclude:
        rows = rows.filter(~F.arrays_overlap("categories", F.array(*[F.lit(x) for x in exclude])))
    absolute = F.when(F.col("link").rlike("^https?://"), F.col("link")).otherwise(F.concat(F.regexp_extract("base_url", r"^(https?://[^/]+)", 1), F.col("link")))
    rows = rows.select("source_id", "pos", T.strip_tags(F.col("title")).alias("title"), U.canonical_url(absolute).alias("url"), D.parse_known(F.col("date")).alias("published_at"), T.strip_tags(F.col("summary")).alias("summary"))
    rows = rows.filter("title is not null and url is not null")
    first = Window.partitionBy("source_id", "url").orderBy("pos")
    kept = rows.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).filter(F.col("k") <= max(1, min(10_000, max_items))).drop("k")


def is_feed(responses: DataFrame) -> DataFrame:
    """responses(source_id, base_url, content_type, body) -> source_id, entries, valid, feed.

    A feed says so by its content type or its root element, and at least half of its entries have a title and a valid link."""
    e = F.col("e")
    absolute = F.when(e["link"].rlike("^https?://"), e["link"]).otherwise(F.concat(F.regexp_extract("base_url", r"^(https?://[^/]+)", 1), e["link"]))
    rows = responses.select("source_id", "base_url", "content_type", "body", F.explode_outer(F.pandas_udf(_parse, ENTRY)("body")).alias("e"))
    valid = (F.trim(e["title"]) != "") & U.canonical_url(absolute).isNotNull()
    named = F.coalesce(F.lower("content_type").rlike("rss|atom"), F.lit(False)) | F.coalesce(F.substring("body", 1, 2000).rlike(r"(?is)<(\w+:)?(rss|feed|rdf)[\s>]"), F.lit(False))
    out = rows.select("source_id", named.alias("named"), e.isNotNull().alias("entry"), F.coalesce(valid, F.lit(False)).alias("valid"))
    out = out.groupBy("source_id").agg(F.max("named").alias("named"), F.count_if("entry").alias("entries"), F.count_if(F.col("entry") & F.col("valid")).alias("valid"))
    return out.select("source_id", "entries", "valid", (F.col("named") & (F.col("valid") > 0) & (2 * F.col("valid") >= F.col("entries"))).alias("feed"))
