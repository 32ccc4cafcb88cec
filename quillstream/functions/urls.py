"""Addresses: validity, hosts and the canonical form."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, beside utm_*.
TRACKING = ["dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid"]
#: Addresses that canonical_fast brings to the exact form: plain ASCII, no port, no escapes, no dots to resolve.
PLAIN = r"^https?://[A-Za-z0-9.-]+[A-Za-z0-9](/[A-Za-z0-9._~/-]*)?(\?[A-Za-z0-9._~-]+=[A-Za-z0-9._~-]*(&[A-Za-z0-9._~-]+=[A-Za-z0-9._~-]*)*)?(#[^#]*)?$"


def is_http_url(url: Column) -> Column:
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def same_site(url: Column, site_host: Column) -> Column:
    """The host itself or a subdomain."""
    h = host(url)
    return (h == site_host) | F.endswith(h, F.concat(F.lit("."), site_host))


def wanted_key(key: str, keep: frozenset | None) -> bool:
    """A kept key where some are named, else one that does not track."""
    return key in keep if keep is not None else not key.lower().startswith("utm_") and key.lower() not in TRACKING


def canonical_one(url: str | None, base: str | None = None, keep: frozenset | None = None) -> str | None:
    try:
        parts = urlsplit((urljoin(base, url) if base else url or "").strip())
        name, port, scheme = (parts.hostname or "").rstrip(".").encode("idna").decode(), parts.port, parts.scheme.lower()
    except (ValueError, UnicodeError):
        return None
    if scheme not in ("http", "https") or not name:
        return None
    name = f"[{name}]" if ":" in name else name
    if port is not None and port != {"http": 80, "https": 443}[scheme]:
        name += f":{port}"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if wanted_key(k, keep))
    return f"{scheme}://{name}{parts.path.rstrip('/') or '/'}" + (f"?{urlencode(query)}" if query else "")


def canonical_exact(url: Column, base: Column | None = None, keep: list[str] | None = None) -> Column:
    """Exact canonical form of any address, resolved against base, in Python."""
    kept = None if keep is None else frozenset(keep)

    def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else canonical_one(u, b, kept) for u, b in zip(urls, bases, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(url, F.lit(None).cast("string") if base is None else base)


def canonical_url(url: Column | str, base: Column | None = None, keep: list[str] | None = None) -> Column:
    """Canonical form: host in lower case and IDNA, no default port, no trailing slash, query sorted and without tracking
    keys (with keep: only the named keys), no fragment, no user; relative addresses resolve against base; null if
    invalid.  Only addresses that are not PLAIN leave the JVM."""
    url = F.col(url) if isinstance(url, str) else url
    plain = F.coalesce(url.rlike(PLAIN), F.lit(False))
    return F.when(plain, canonical_fast(url, keep)).otherwise(canonical_exact(F.when(~plain, url), base, keep))


def canonical_fast(url: Column, keep: list[str] | None = None) -> Column:
    """The canonical form of PLAIN addresses, inside the JVM."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    key = lambda p: F.split(p, "=")[0]
    stays = (lambda p: key(p).isin(keep)) if keep is not None else lambda p: ~F.startswith(F.lower(p), F.lit("utm_")) & ~F.lower(key(p)).isin(TRACKING)
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & stays(p))
    # by key, then value: the sign between them must not take part in the order
    parted = F.array_sort(F.transform(pairs, lambda p: F.struct(key(p).alias("k"), p.alias("p"))))
    query = F.array_join(F.transform(parted, lambda x: x["p"]), "&")
    out = F.concat(scheme, F.lit("://"), F.regexp_replace(host(url), r"\.$", ""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(is_http_url(url), out)


def first_segment(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]+)", 1), F.lit(""))


def repository(url: Column) -> Column:
    """owner/name of a code host's page, API address or plain pair."""
    found = F.regexp_extract(url, r"^(?:https?://(?:www\.)?github\.com/|https?://api\.github\.com/repos/)?([A-Za-z0-9._-]+/[A-Za-z0-9._-]+?)(?:\.git)?(?:[/?#].*)?$", 1)
    return F.nullif(found, F.lit(""))
