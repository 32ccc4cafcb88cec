"""From collected rows to stored items: normalisation, parents, opportunity fields, backfill, previews and source outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

INTERNAL = "_source_discoveries"  # fixed value: the key of extra that no source may set


def normalize_items(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """rows(title, original_url, summary, published_at, extra as JSON) -> the same with canonical_url and error.

    Blanks collapse, an empty summary is null, the internal key leaves extra.  error says why a row is no item (null if it
    is one); rows with an error stay, so that a source's failures can be counted."""
    title, url = T.collapse(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("original_url", F.lit("")))
    extra = F.try_parse_json(F.coalesce("extra", F.lit("{}")))
    # null where the text is no JSON object
    fields = F.from_json(F.when(F.startswith(F.schema_of_variant(extra), F.lit("OBJECT")), F.coalesce("extra", F.lit("{}"))), "map<string,string>")
    out = rows.withColumns({"title": title, "original_url": url, "summary": F.nullif(T.collapse("summary"), F.lit(""))})
    out = out.withColumns({"canonical_url": U.canonical_url("original_url", keep=keep), "_fields": fields})
    error = (
        F.when(F.col("title") == "", "item title is empty")
        .when(~U.is_http_url(F.col("original_url")), "item URL must be an absolute HTTP(S) URL")
        .when(F.col("canonical_url").isNull(), "item URL cannot be canonicalized")
        .when(F.col("_fields").isNull(), "item extra must be a JSON object with string keys")
    )
    return out.withColumn("error", error).withColumn("extra", F.to_json(F.map_filter("_fields", lambda k, _: k != INTERNAL))).drop("_fields")


def with_parents(items: DataFrame) -> DataFrame:
    """items(id, source_id, fingerprint, parent_fingerprint, parent_item_id): a child finds its parent within its source by
    fingerprint (the smallest id of equal ones); a link that is already set stays, and none is ever cleared."""
    parents = items.filter("fingerprint is not null").groupBy(F.col("source_id").alias("_s"), F.col("fingerprint").alias("_f")).agg(F.min("id").alias("_p"))
    near = (F.col("source_id") == F.col("_s")) & (F.col("parent_fingerprint") == F.col("_f")) & (F.length("parent_fingerprint") == 64)
    found = F.when(F.col("_p") != F.col("id"), F.col("_p"))
    return items.join(parents, near, "left").withColumn("parent_item_id", F.coalesce(found, F.col("parent_item_id"))).drop("_s", "_f", "_p")


# Labels of notices and the form of their dates and quantified outcomes.
LABELS = {"organizer": ("主办机构", 500), "application_target": ("申报对象", 2000), "application_method": ("申报方式", 2000)}
DEADLINE = r"(?:截止(?:时间|日期)?|申报截止)[^。；;\n]{0,30}"
DATE = r"(20\d{2})[年./-](0?[1-9]|1[0-2])[月./-](0?[1-9]|[12]\d|3[01])日?"
QUANTIFIED = r"\d+(?:\.\d+)?\s*(?:%|倍|万|亿|小时|分钟|天|元|人)"


def opportunity_fields(title: Column, summary: Column, extra: Column, kind: Column) -> Column:
    """Who calls, for what, for whom, how and until when; only for application opportunities, else all null.

    extra (JSON) comes first, then what follows a label in the text; a deadline is the end of its day in Shanghai.  As the
    fixed date form tries one digit first, a day of two digits counts as its first one."""
    text = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(summary, F.lit("")))
    given = lambda k, n: F.nullif(F.substring(T.collapse(F.get_json_object(extra, f"$.{k}")), 1, n), F.lit(""))
    labelled = {k: F.coalesce(given(k, n), F.nullif(F.trim(F.regexp_extract(text, label + r"\s*[:：]\s*([^。；;\n]{1,500})", 1)), F.lit(""))) for k, (label, n) in LABELS.items()}
    near = F.regexp_extract(text, DEADLINE, 0)
    day = F.try_to_timestamp(F.concat_ws("-", *[F.lpad(F.regexp_extract(near, DATE, i), 2 if i > 1 else 4, "0") for i in (1, 2, 3)]), F.lit("yyyy-MM-dd"))
    fields = {
        "organizer": labelled["organizer"], "application_name": F.coalesce(given("application_name", 500), F.substring(title, 1, 500)), "application_target": labelled["application_target"],
        "deadline_at": F.when(near.rlike(DATE), F.to_utc_timestamp(day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), "Asia/Shanghai")),
        "application_method": labelled["application_method"], "application_url": U.canonical_url(F.get_json_object(extra, "$.application_url")),
    }
    return F.struct(*[F.when(kind == "application_opportunity", v).alias(k) for k, v in fields.items()])


def quantified(text: Column) -> Column:
    return text.rlike(QUANTIFIED)


def backfill(items: DataFrame, tags: dict[str, list[str]], types: list[tuple[list[str], list[str], str]], case_words: list[str], case_categories: list[str]) -> DataFrame:
    """Second-generation fields from first-generation categories, as one projection.

    tags: category -> topic tags; types: (categories, title words, primary type), the first that fits; a case lead has one of
    the case words in its title; formal sources are confirmed; a manual category keeps the type that was derived."""
    some = lambda words: F.reduce(F.array(*[F.contains("title", F.lit(w)) for w in words]), F.lit(False), lambda a, x: a | x)
    topic = F.array().cast("array<string>")
    for category, names in tags.items():
        topic = F.when(F.col("category") == category, F.array(*[F.lit(n) for n in names])).otherwise(topic)
    kind = F.lit("unclassified")
    for categories, words, name in reversed(types):
        kind = F.when(F.col("category").isin(categories) & some(words), name).otherwise(kind)
    lead = some(case_words) & F.col("category").isin(case_categories)
    out = items.withColumns({"topic_tags": topic, "primary_type": kind, "case_completeness": F.when(lead, "case_lead").otherwise("not_case")})
    formal = F.col("source_kind") == "formal"
    return out.withColumns({
        "verification_status": F.when(formal, "official_confirmed").otherwise(F.col("verification_status")),
        "review_status": F.when(formal, "not_required").otherwise(F.col("review_status")),
        "manual_primary_type": F.when(F.col("manual_category").isNotNull() & (F.col("primary_type") != "unclassified"), F.col("primary_type")).otherwise(F.col("manual_primary_type")),
    })


#: Columns of which values are counted, with the map's name.
HISTOGRAMS = {"primary_type": "primary_types", "verification_status": "verification_statuses", "review_status": "review_statuses"}


def preview_stats(rows: DataFrame) -> DataFrame:
    """rows(source_id, site_host, error, canonical_url, published_at, accepted, reason) -> one row a source: its status, sums,
    ratios over the rows without an error (one at least), and maps of how often each failure and each rejection occurs
    and, of those of HISTOGRAMS that rows have, each value among the rows without an error.

    A row whose address an earlier one has counts as a duplicate: all but one of each address do.  A source with rows
    of which none is without an error has failed.  Maps of nothing are null."""
    valid = F.col("error").isNull()
    host = U.host(F.col("canonical_url"))
    ok, dated, linked = F.count_if(valid), F.count_if(valid & F.col("published_at").isNotNull()), F.count_if(valid & (host != ""))
    n = F.greatest(ok, F.lit(1))
    outside = F.count_if(valid & (host != "") & (host != F.col("site_host")))
    twice = ok - F.count_distinct(F.when(valid, F.col("canonical_url")))
    sums = rows.groupBy("source_id").agg(
        F.when(ok == 0, "failed").otherwise("success").alias("status"), F.count(F.lit(1)).alias("discovered"), ok.alias("normalized"),
        F.count_if(valid & F.col("accepted")).alias("accepted"), F.count_if(valid & ~F.col("accepted")).alias("rejected"), F.count_if(~valid).alias("failed"),
        (ok / n).alias("title_ratio"), (dated / n).alias("date_ratio"), (linked / n).alias("link_ratio"), (outside / n).alias("external_ratio"), twice.alias("duplicates"), (twice / n).alias("duplicate_ratio"),
    )
    counted = {"failures": F.col("error"), "rejections": F.when(valid & ~F.col("accepted"), F.col("reason"))} | {name: F.when(valid, F.col(c)) for c, name in HISTOGRAMS.items() if c in rows.columns}
    # one pass for all maps: a row for each value, counted before it is sent
    values = F.array(*[F.struct(F.lit(name).alias("map"), v.alias("k")) for name, v in counted.items()])
    counts = rows.select("source_id", F.inline(values)).filter("k is not null").groupBy("source_id", "map", "k").agg(F.count(F.lit(1)).alias("n"))
    entries = lambda name: F.array_sort(F.collect_list(F.when(F.col("map") == name, F.struct("k", "n"))))
    maps = counts.groupBy(F.col("source_id").alias("_of")).agg(*[F.when(F.size(entries(name)) > 0, F.map_from_entries(entries(name))).alias(name) for name in counted])
    return sums.join(maps, F.col("source_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def preview(rows: DataFrame, most: int = 10) -> DataFrame:
    """rows(source_id, pos, title, canonical_url, error, accepted) -> the first items of each source to show before it is added.

    Rows with an error, rejected ones and repeated addresses or titles do not count.  A source of which three or more and
    two thirds of the rows do not count shows nothing."""
    good = rows.withColumn("good", F.col("error").isNull() & F.col("accepted"))
    first = lambda key: F.row_number().over(Window.partitionBy("source_id", "good", key).orderBy("pos")) == 1
    good = good.withColumn("good", F.col("good") & first("canonical_url") & first(F.lower("title")))
    good = good.withColumn("place", F.sum(F.col("good").cast("int")).over(Window.partitionBy("source_id").orderBy("pos")))
    # reading stops when enough items are found: what stands after them is neither shown nor counted against the source
    read = good.withColumn("read", F.col("place") - F.col("good").cast("int") < most)
    bad = read.groupBy("source_id").agg(F.count_if(F.col("read") & ~F.col("good")).alias("bad"), F.count(F.lit(1)).alias("all"))
    spoilt = (F.col("bad") >= 3) & (F.col("bad") * 3 >= F.col("all") * 2)
    return read.filter("good and read").join(bad.filter(~spoilt).select("source_id"), "source_id", "left_semi").select("source_id", "pos", "title", "canonical_url")


def failure_reason(phase: Column, kind: Column) -> Column:
    """The counted reason of an error: kind is value, lookup, fetch or anything else."""
    return (
        F.when((phase == "configuration") | ((phase == "collection") & kind.isin("value", "lookup")), "source.configuration_invalid")
        .when(kind == "fetch", "fetch.failed").when(phase == "collection", "parse_or_collection.failed").when(phase == "persistence", "persistence.failed")
        .otherwise(F.concat(phase, F.lit(".failed")))
    )


def fetch_error(status: Column, limited: Column) -> Column:
    """The class of an HTTP status, null if the response is usable; limited: the response says that a limit was reached."""
    return (
        F.when((status == 429) | ((status == 403) & limited), "rate_limit").when(status == 403, "forbidden").when(status == 404, "not_found")
        .when(status >= 500, "server").when(status >= 400, "http")
    )


def source_states(sources: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """sources(id, last_checked, last_success, last_error) after outcomes(source_id, discovered, valid, error).

    A success sets both times and clears the error.  A source that found records of which none is valid has failed."""
    o = outcomes.select(F.col("source_id").alias("_id"), F.coalesce("error", F.when((F.col("discovered") > 0) & (F.col("valid") == 0), "all collected records failed normalization")).alias("_error"), F.lit(True).alias("_seen"))
    seen, won = F.coalesce(F.col("_seen"), F.lit(False)), F.col("_seen") & F.col("_error").isNull()
    out = sources.join(o, F.col("id") == F.col("_id"), "left")
    return out.withColumns({
        "last_checked": F.when(seen, at).otherwise(F.col("last_checked")), "last_success": F.when(won, at).otherwise(F.col("last_success")), "last_error": F.when(seen, F.col("_error")).otherwise(F.col("last_error")),
    }).drop("_id", "_error", "_seen")


def round_report(rounds: DataFrame) -> DataFrame:
    """rounds(source_id, round, success, error, reasons, discovered, accepted, new, duplicate) -> one row: sums over two rounds
    of all sources, and how often each class of failure occurs."""
    error = F.lower(F.coalesce("error", F.lit("")))
    network = F.when(F.contains(error, F.lit("timeout")), "timeout").when(error.rlike("http |rate limit|forbidden"), "http").otherwise("network")
    why = F.when(F.array_contains("reasons", "fetch.failed"), network).when(F.array_contains("reasons", "parse_or_collection.failed"), "parse").otherwise("other")
    rows = rounds.withColumn("why", F.when(~F.col("success"), why))
    of = lambda n, c: F.sum(F.when(F.col("round") == n, F.col(c)).otherwise(0)).alias(f"{c}_{n}")
    return rows.agg(
        F.count_distinct("source_id").alias("active_total"), F.count(F.lit(1)).alias("source_rounds"), F.count_if("success").alias("successful_rounds"), F.count_if(~F.col("success")).alias("failed_rounds"),
        *[F.count_if(F.col("why") == k).alias(f"failed_{k}") for k in ("timeout", "http", "network", "parse", "other")],
        *[of(1, c) for c in ("discovered", "accepted", "new")], *[of(2, c) for c in ("discovered", "accepted", "new", "duplicate")],
    )


def sanitized(settings: DataFrame, secrets: tuple[str, ...] = ("api_key",)) -> DataFrame:
    """A copy without its secrets: the named columns are blank."""
    return settings.withColumns({c: F.lit("") for c in settings.columns if c in secrets})


def updated(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """store with the columns of changes set where keys agree; a column that the store lacks is an error."""
    unknown = set(changes.columns) - set(store.columns)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), F.struct(*fields).alias("_new"))
    out = store.join(new, key, "left")
    return out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in store.columns])
