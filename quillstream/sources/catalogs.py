"""Source catalogues and taxonomy packs from YAML or JSON text, checked whole before anything is done with them.

As with packs of scored terms, a text that breaks a rule is refused with all of its faults in one message.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .. import domains as D
from ..functions.text import normalize_one
from ..functions.urls import canonical_one
from ..operators.taxonomy import VERSION, RoleRule, Tags
from .rule_packs import PackError, exact, number, read

#: An entry's keys with what they hold: a closed domain, a kind of value, or bounds of an integer.  Fixed values.
ENTRY = {
    "slug": "slug", "name": "text", "url": "url", "lifecycle_state": D.LIFECYCLES, "source_role": D.ROLES, "source_tier": D.TIERS, "audience": D.AUDIENCES,
    "crawl_mode": ["rss", "html_list", "single_page_changelog", "document_hub", "case_hub", "api", "custom", "rsshub"], "review_policy": D.POLICIES, "allowed_primary_types": "types", "homepage_visible": "flag", "export_visible": "flag",
    "lookback_days": (0, 3650), "max_items_per_run": (1, 200), "implementation_status": D.IMPLEMENTATION, "implementation_reason": "text", "verified_at": "time?", "activation_evidence": "text?",
    "notes": "text", "collector_name": "text", "collector_config": "mapping", "include_terms": "texts", "exclude_terms": "texts", "minimum_quality_score": "score", "allow_external_links": "flag",
}
RULE = ("id", "priority", "primary_type", "subject_terms", "action_terms", "exclude_terms", "topic_tags")
SLUG = re.compile(r"[a-z0-9-]{1,100}")


def _is_text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _zoned(x) -> datetime | None:
    """x as a time with its zone, null if it is none."""
    if isinstance(x, str):
        try:
            x = datetime.fromisoformat(x)
        except ValueError:
            return None
    return x if isinstance(x, datetime) and x.tzinfo is not None else None


def _texts(found, where: str, faults: list[str], same=lambda t: t) -> list[str]:
    """A list of texts without blanks around them, no two of them the same."""
    if not isinstance(found, list) or not all(map(_is_text, found)):
        faults.append(f"{where}: needs a list of texts")
        return []
    out = [t.strip() for t in found]
    faults += [f"{where}: {t!r} given twice" for t, n in Counter(map(same, out)).items() if n > 1]
    return out


def _value(kind, x, where: str, faults: list[str]):
    """x as this kind of value; null, with a fault, if it is none."""
    if isinstance(kind, str) and kind.endswith("?"):
        return None if x is None else _value(kind[:-1], x, where, faults)
    if isinstance(kind, tuple):
        good, out = isinstance(x, int) and not isinstance(x, bool) and kind[0] <= x <= kind[1], x
    elif isinstance(kind, list):
        good, out = _is_text(x) and x.strip() in kind, x.strip() if isinstance(x, str) else x
    elif kind in ("texts", "types"):
        out = _texts(x, where, faults)
        good = kind == "texts" or all(t in D.PRIMARY_TYPES for t in out)
    elif kind == "flag":
        good, out = isinstance(x, bool), x
    elif kind == "mapping":
        good, out = isinstance(x, dict) and all(isinstance(k, str) for k in x), x
    elif kind == "score":
        good, out = number(x) and 0 <= x <= 100, float(x) if number(x) else x
    elif kind == "time":
        out = _zoned(x)
        good = out is not None
    else:
        good, out = _is_text(x), x.strip() if isinstance(x, str) else x
        if good and kind == "slug":
            good = bool(SLUG.fullmatch(out))
        if good and kind == "url":
            out = canonical_one(out)
            good = out is not None
    if not good:
        faults.append(f"{where}: not allowed: {x!r}")
    return out if good else None


def _entry(found, where: str, faults: list[str]) -> dict:
    """An entry of a catalogue.  Active ones must be ready, verified and have evidence; sources of leads stay hidden and reviewed."""
    before = len(faults)
    e = {k: _value(ENTRY[k], v, f"{where}.{k}", faults) for k, v in exact(found, tuple(ENTRY), where, faults).items()}
    if len(faults) > before:
        return e
    if e["lifecycle_state"] == "active" and (e["implementation_status"] != "ready" or e["verified_at"] is None or e["activation_evidence"] is None):
        faults.append(f"{where}: active without being ready, verified and evidenced")
    if e["source_role"] == "media_discovery" and (e["homepage_visible"] or e["export_visible"] or e["review_policy"] != "always_review"):
        faults.append(f"{where}: media_discovery must be hidden and always_review")
    return e


def load_catalog(text: str, retired: tuple[str, ...] = ()) -> list[dict]:
    """The entries of a catalogue (version 1), in order; no slug or address twice, none of the retired addresses."""
    faults: list[str] = []
    root = exact(read(text), ("version", "sources"), "catalog", faults)
    if root.get("version") != 1:
        faults.append("catalog.version: must be 1")
    listed = root.get("sources", [])
    if not isinstance(listed, list):
        faults.append("sources: not a list")
        listed = []
    entries = [_entry(x, f"sources[{i}]", faults) for i, x in enumerate(listed, 1)]
    for key in ("slug", "url"):
        faults += [f"{key} given twice: {x}" for x, n in Counter(e.get(key) for e in entries).items() if n > 1 and x is not None]
    gone = {canonical_one(u) or u for u in retired}
    faults += [f"retired: {e['slug']}" for e in entries if e.get("url") in gone]
    if faults:
        raise PackError("\n".join(faults))
    return entries


def catalog_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The entries as what `catalog_sync` wants: a row each, with their place; the collector's settings are JSON."""
    rows = [
        (e["slug"], e["url"], e["lifecycle_state"], i, e["name"], e["source_role"], e["source_tier"], e["audience"], e["review_policy"], e["implementation_status"], e["homepage_visible"], e["export_visible"],
         e["crawl_mode"], e["allowed_primary_types"], e["lookback_days"], e["max_items_per_run"], e["implementation_reason"], e["verified_at"], e["activation_evidence"], e["notes"], e["collector_name"],
         json.dumps(e["collector_config"], sort_keys=True, ensure_ascii=False, default=str), e["include_terms"], e["exclude_terms"], e["minimum_quality_score"], e["allow_external_links"])
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, (
        "slug string, start_url string, lifecycle string, position long, name string, role string, tier string, audience string, policy string, implementation string, homepage_visible boolean, export_visible boolean, "
        "crawl_mode string, allowed_types array<string>, lookback_days int, max_items_per_run int, implementation_reason string, verified_at timestamp, activation_evidence string, notes string, collector_name string, "
        "collector_config string, include_terms array<string>, exclude_terms array<string>, minimum_quality_score double, allow_external_links boolean"
    ))


def load_role_pack(text: str, role: str) -> list[RoleRule]:
    """The rules of a role's pack, highest priority first, with normalised terms; the fallback role has no rules."""
    if role == "fallback":
        return []
    faults: list[str] = []
    root = exact(read(text), ("version", "role", "rules"), "pack", faults)
    if root.get("version") != VERSION:
        faults.append(f"pack.version: must be {VERSION}")
    if root.get("role") != role:
        faults.append(f"pack.role: not {role}")
    listed = root.get("rules", [])
    if not isinstance(listed, list):
        faults.append("rules: not a list")
        listed = []
    rules, ids = [], []
    for i, found in enumerate(listed, 1):
        where = f"rules[{i}]"
        body = exact(found, RULE, where, faults)
        if len(body) < len(RULE):
            continue
        if not _is_text(body["id"]):
            faults.append(f"{where}.id: needs a text")
        if not isinstance(body["priority"], int) or isinstance(body["priority"], bool):
            faults.append(f"{where}.priority: needs an integer")
        kind = _value(D.PRIMARY_TYPES, body["primary_type"], f"{where}.primary_type", faults)
        parts = [tuple(normalize_one(t) for t in _texts(body[k], f"{where}.{k}", faults, str.casefold)) for k in RULE[3:6]]
        topics = _texts(body["topic_tags"], f"{where}.topic_tags", faults, str.casefold)
        faults += [f"{where}.topic_tags: no topic {t!r}" for t in topics if t not in D.TOPICS]
        ids.append(body["id"])
        rules.append(RoleRule(str(body["id"]).strip(), role, body["priority"], kind, *parts, tuple(topics)))
    faults += [f"rule given twice: {r}" for r, n in Counter(map(str, ids)).items() if n > 1]
    if faults:
        raise PackError("\n".join(faults))
    return sorted(rules, key=lambda r: -r.priority)


def load_tags(text: str) -> Tags:
    """The terms of every topic and of every industry but the general one, normalised."""
    faults: list[str] = []
    root = exact(read(text), ("version", "topic_tags", "industry_tags"), "tags", faults)
    if root.get("version") != VERSION:
        faults.append(f"tags.version: must be {VERSION}")
    kinds = []
    for key, wanted in (("topic_tags", D.TOPICS), ("industry_tags", [i for i in D.INDUSTRIES if i != "general"])):
        found = exact(root.get(key, {}), wanted, key, faults)
        kinds.append({t: [normalize_one(x) for x in _texts(found[t], f"{key}.{t}", faults, str.casefold)] for t in wanted if t in found})
    if faults:
        raise PackError("\n".join(faults))
    return Tags(*kinds)
