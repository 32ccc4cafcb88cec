"""Text functions: Column to Column, with Arrow UDFs only where Spark has no primitive."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese punctuation and what stands for it.
PUNCTUATION = {
    "，": ",", "。": ".", "！": "!", "？": "?", "：": ":", "；": ";", "“": '"', "”": '"', "‘": "'", "’": "'",
    "（": "(", "）": ")", "【": "[", "】": "]", "《": " ", "》": " ", "、": " ", "…": " ", "—": "-", "－": "-",
}
#: Text that compatibility normalisation leaves alone and whose folded case is its lower case.
STABLE = r"^[\x00-\x7FÀ-ÖØ-Þà-öø-ÿ\x{4E00}-\x{9FFF}。“”‘’【】《》、—]*$"


def normalize_one(text: str | None) -> str:
    out = unicodedata.normalize("NFKC", text or "")
    for a, b in PUNCTUATION.items():
        out = out.replace(a, b)
    return re.sub(r"\s+", " ", out).strip().casefold()


def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_one, na_action=None)


def normalize_exact(text) -> Column:
    """Compatibility form, plain punctuation, single blanks, case folded; null becomes empty."""
    return F.pandas_udf(_normalize, "string")(text)


def normalize_text(text: Column) -> Column:
    """The same; only texts that are not STABLE leave the JVM."""
    plain = F.coalesce(text, F.lit("")).rlike(STABLE)
    return F.when(plain, normalize_fast(text)).otherwise(normalize_exact(F.when(~plain, text)))


def normalize_fast(text: Column) -> Column:
    """The same for STABLE text, without leaving the JVM."""
    out = F.translate(F.coalesce(text, F.lit("")), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def fingerprint(normal_title: Column) -> Column:
    """Null for an empty title."""
    return F.when(normal_title != "", F.sha2(F.concat(F.lit("title:v1\0"), normal_title), 256))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bounded(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def item_ref(canonical_url: Column) -> Column:
    return F.substring(F.sha2(canonical_url, 256), 1, 16)


def request_signature(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def user_slug(url: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(url, 256), 1, 16))


def valid_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & F.length(text).between(1, 100)


def strip_tags(text: Column) -> Column:
    """Plain text of simple markup: scripts and styles go, tags become blanks, five entities are read; null if empty."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.nullif(collapse(out), F.lit(""))


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return collapse(F.regexp_replace(out, r"[*_`#>~]+", ""))


def headline(text: Column) -> Column:
    """The part in leading heavy brackets, of 4 to 199 characters, else the text."""
    found = F.regexp_extract(text, r"^【([^】]{4,199})】", 1)
    return F.when(found != "", found).otherwise(text)


def label_value(text: Column, label: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, label + r"\s*[:：]\s*([^。；;\n]{1,500})", 1)), F.lit(""))


def sanitize_error(text: Column, most: int = 500) -> Column:
    """An error that may be shown: no tags, secrets, or queries and user names of addresses."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    out = redact(out)
    out = F.regexp_replace(out, r"(https?://)[^/@\s]*@", "$1")
    out = F.regexp_replace(out, r"(https?://[^\s?#]*)[?#]\S*", "$1")
    return bounded(collapse(out), most)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2***")


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) < 7, "****").otherwise(F.concat(F.substring(key, 1, 3), F.lit("****"), F.substring(key, -4, 4)))


def formula_safe(text: Column, most: int = 32_767) -> Column:
    """A cell that no spreadsheet evaluates: control characters go, a leading sign of a formula gets an apostrophe.

    A negative number, also in exponent form or with a percent sign, is none; the apostrophe counts for `most`."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    out = bounded(clean, most)
    risky = out.rlike(r"(?U)^[\s\p{Cc}\p{Cf}]*[=+\-@]") & ~out.rlike(r"(?U)^[\s\p{Cc}\p{Cf}]*-(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?%?\s*$")
    return F.when(risky, F.concat(F.lit("'"), bounded(clean, most - 1))).otherwise(out)


def safe_filename(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "-"), 1, 120)


def sheet_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\[\]:*?/\\]", "-"), 1, 31)


def safe_link(url: Column) -> Column:
    return F.when((F.length(url) <= 2048) & url.rlike(r"^https?://[^\s\x00-\x1F]+$"), url)


def contains_term(text: Column, term: str) -> Column:
    """An ASCII term stands between non-alphanumerics, any other is a substring."""
    if re.fullmatch(r"[a-z0-9][a-z0-9+.#/-]*", term):
        # the plain search is many times faster than the pattern and fails for most terms
        return F.contains(text, F.lit(term)) & text.rlike(rf"(?<![a-z0-9])\Q{term}\E(?![a-z0-9])")
    return F.contains(text, F.lit(term))
