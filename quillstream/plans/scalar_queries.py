"""Scalar function queries (FN-1 to FN-33, SINK-5, SINK-6, STR-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from . import fixtures as X
from .registry import query

_NORMAL = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("fingerprint_hash", X.WITH + f"SELECT id, CASE WHEN {_NORMAL.format('title')} <> '' THEN sha256(concat('title:v1', chr(0), {_NORMAL.format('title')})) END AS fingerprint FROM items")
def fingerprint_hash(spark, d):
    return X.items(spark, d).select("id", T.fingerprint(T.normalize_text(F.col("title"))).alias("fingerprint"))


@query("normalize_text_exact", X.WITH + f"SELECT id, {_NORMAL.format('title')} AS normal FROM items")
def normalize_text_exact(spark, d):
    return X.items(spark, d).select("id", T.normalize_exact("title").alias("normal"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"
_PAIRS = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT list_contains(['dclid', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'msclkid'], lower(split_part(p, '=', 1)))))"
_CANON = f"concat(regexp_extract(url, '^(https?)', 1), '://', {_HOST}, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, CASE WHEN len({_PAIRS}) > 0 THEN concat('?', array_to_string({_PAIRS}, '&')) ELSE '' END)"


@query("canonical_url_ascii", f"SELECT page_id, {_CANON} AS url, {_HOST} AS host FROM pages")
def canonical_url_ascii(spark, d):
    return X.table(spark, d, "pages").select("page_id", U.canonical_fast(F.col("url")).alias("url"), U.host(F.col("url")).alias("host"))


@query("canonical_url_exact", f"SELECT page_id, {_CANON} AS url FROM pages")
def canonical_url_exact(spark, d):
    return X.table(spark, d, "pages").select("page_id", U.canonical_exact(F.col("url")).alias("url"))


_KEPT = _CANON.replace("NOT starts_with(lower(p), 'utm_') AND NOT list_contains(['dclid', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'msclkid'], lower(split_part(p, '=', 1)))", "list_contains(['id', 'utm_source', 'page'], split_part(p, '=', 1))")
_TRACKED = "concat(regexp_replace(url, '#.*', ''), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_source=x&dclid=1&ref=2&from=3&page=', CAST(page_id % 5 AS VARCHAR(9)), '&MSCLKID=7')"


@query("canonical_url_tracking", f"SELECT page_id, {_CANON} AS url, {_KEPT} AS kept FROM (SELECT page_id, {_TRACKED} AS url FROM pages)")
def canonical_url_tracking(spark, d):
    pages = X.table(spark, d, "pages").selectExpr("page_id", f"{_TRACKED} AS url")
    return pages.select("page_id", U.canonical_url("url").alias("url"), U.canonical_url("url", keep=["id", "utm_source", "page"]).alias("kept"))


_MARKED = "concat('《', title, '》、', summary, '—')"


_PLAIN = f"replace(replace(replace(replace({_MARKED}, '《', ' '), '》', ' '), '、', ' '), '—', '-')"


@query("normalize_punctuation", X.WITH + f"SELECT id, {_NORMAL.format(_PLAIN)} AS normal FROM items WHERE summary IS NOT NULL")
def normalize_punctuation(spark, d):
    rows = X.items(spark, d).filter("summary is not null").selectExpr("id", f"{_MARKED} AS t")
    return rows.select("id", T.normalize_text(F.col("t")).alias("normal"))


@query("item_references", f"SELECT page_id, substr(sha256(url), 1, 16) AS ref, concat('user-', substr(sha256(url), 1, 16)) AS slug FROM pages")
def item_references(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.item_ref(F.col("url")).alias("ref"), T.user_slug(F.col("url")).alias("slug"))


_PREFIXES = ["=1+", "-5", " +x", "@a", "plain ", "-x"]
_PREFIX_SQL = "CASE id % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + " END"
_CELL = f"CASE WHEN id % 12 = 1 THEN '-5' ELSE concat({_PREFIX_SQL}, title) END"


def safe_cell_sql(c: str, most: int = 32_767) -> str:
    """The second engine's form of a safe cell."""
    cut = lambda n: f"CASE WHEN length({c}) > {n} THEN concat(substr({c}, 1, {n - 1}), '…') ELSE {c} END"
    number = "'^\\s*-(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?%?\\s*$'"
    return f"CASE WHEN regexp_matches({cut(most)}, '^\\s*[=+\\-@]') AND NOT regexp_matches({cut(most)}, {number}) THEN concat('''', {cut(most - 1)}) ELSE {cut(most)} END"


@query("formula_safe_text", X.WITH + f"SELECT id, {safe_cell_sql('cell')} AS cell FROM (SELECT id, {_CELL} AS cell FROM items)")
def formula_safe_text(spark, d):
    return X.items(spark, d).selectExpr("id", f"{_CELL} AS cell").select("id", T.formula_safe(F.col("cell")).alias("cell"))


@query(
    "bounded_safe_names",
    X.WITH + """SELECT id, CASE WHEN length(title) > 40 THEN concat(substr(title, 1, 39), '…') ELSE title END AS short, substr(regexp_replace(concat(title, ' a/b:c?'), '[<>:"/\\\\|?*]', '-', 'g'), 1, 120) AS file,
    substr(regexp_replace(concat('[', title), '[\\[\\]:*?/\\\\]', '-', 'g'), 1, 31) AS sheet FROM items""",
)
def bounded_safe_names(spark, d):
    t = F.col("title")
    return X.items(spark, d).select("id", T.bounded(t, 40).alias("short"), T.safe_filename(F.concat(t, F.lit(" a/b:c?"))).alias("file"), T.sheet_name(F.concat(F.lit("["), t)).alias("sheet"))


@query(
    "mask_and_redact",
    "SELECT event_id, CASE WHEN length(props) < 7 THEN '****' ELSE concat(substr(props, 1, 3), '****', right(props, 4)) END AS masked, concat('token=*** ', event_type) AS redacted FROM events",
)
def mask_and_redact(spark, d):
    secret = F.concat(F.lit("token="), F.col("event_id"), F.lit(" "), F.col("event_type"))
    return X.table(spark, d, "events").select("event_id", T.mask_key(F.col("props")).alias("masked"), T.redact(secret).alias("redacted"))


@query(
    "local_day_bounds",
    "SELECT event_id, CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS BIGINT) AS day_start, CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR) + INTERVAL 16 HOUR) AS BIGINT) AS day_end, CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 152 HOUR) AS BIGINT) AS week_start FROM events",
)
def local_day_bounds(spark, d):
    ts = F.col("ts").cast("timestamp")
    a, b = D.day_bounds(F.to_date(F.from_utc_timestamp(ts, D.ZONE)))
    return X.table(spark, d, "events").select("event_id", F.unix_timestamp(a).alias("day_start"), F.unix_timestamp(b).alias("day_end"), F.unix_timestamp(D.quick_start("7d", ts)).alias("week_start"))


@query("weekday_mask", "SELECT event_id, CAST(event_id % 127 + 1 AS INTEGER) AS mask, ((event_id % 127 + 1) & (1 << CAST(isodow(ts) - 1 AS INTEGER))) > 0 AS due FROM events")
def weekday_mask(spark, d):
    mask = (F.col("event_id") % 127 + 1).cast("int")
    return X.table(spark, d, "events").select("event_id", mask.alias("mask"), D.has_weekday(mask, F.to_date("ts")).alias("due"))


@query("epoch_and_iso", "SELECT event_id, epoch_us(ts) // 1000000 AS iso, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS seconds, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS millis FROM events")
def epoch_and_iso(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.col("event_id") % 5
    return X.table(spark, d, "events").select("event_id", F.unix_timestamp(D.parse_known(text)).alias("iso"), F.unix_timestamp(D.from_epoch(n, "s")).alias("seconds"), F.unix_millis(D.from_epoch(n, "ms")).alias("millis"))


@query(
    "strip_markdown",
    "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM benchmark",
)
def strip_markdown(spark, d):
    marked = F.concat(F.lit("```x\ny``` **"), F.col("text"), F.lit("** ![](http://a.b/c)"))
    return X.table(spark, d, "benchmark").select("item_id", T.strip_markdown(marked).alias("plain"))


@query("sanitized_errors", "SELECT page_id, concat('failed ', regexp_replace(url, '[?#].*$', ''), ' api_key=***') AS error FROM pages")
def sanitized_errors(spark, d):
    raw = F.concat(F.lit("<b>failed</b>  "), F.col("url"), F.lit(" api_key=abc123"))
    return X.table(spark, d, "pages").select("page_id", T.sanitize_error(raw, 5000).alias("error"))
