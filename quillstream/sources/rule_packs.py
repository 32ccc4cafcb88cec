"""Rule packs from YAML or JSON text, checked before any row is scored, and as a table.

A pack that breaks a rule is refused whole, with every fault in one message, so that a typing error in a weight never
turns into silently different scores.
"""

from __future__ import annotations

import math

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..domains import CATEGORIES
from ..functions.text import normalize_one
from ..operators.rules import Rule, Settings

TERMS = {"phrases": 1, "keywords": 1, "negative_phrases": -1}  #: the sign that points must have
NUMBERS = {"minimum_score": (0, True), "minimum_margin": (0, True), "title_weight": (0, False), "summary_weight": (0, False), "phrase_weight": (1, True)}  #: the bound, and whether it is allowed itself


class PackError(ValueError):
    """All faults of a pack, a line each."""


class Loader(yaml.SafeLoader):
    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if keys.count(k) > 1:
                raise PackError(f"key given twice: {k}")
        return super().construct_mapping(node, deep)


def read(text: str):
    """The text's value; one that is no YAML or gives a key twice is refused."""
    try:
        return yaml.load(text, Loader=Loader)  # noqa: S506 - a safe loader
    except yaml.YAMLError as e:
        raise PackError(f"not readable: {e}") from e


def exact(found, wanted, where: str, faults: list[str]) -> dict:
    """found as a mapping of exactly these keys; what is absent is left out."""
    if not isinstance(found, dict):
        faults.append(f"{where}: not a mapping")
        return {}
    faults += [f"{where}: unknown key {k}" for k in found if k not in wanted] + [f"{where}: no {k}" for k in wanted if k not in found]
    return {k: v for k, v in found.items() if k in wanted}


def number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def _terms(found, sign: int, where: str, faults: list[str]) -> dict[str, float]:
    """Term -> points without their sign; terms that are the same once normalised are a fault."""
    if not isinstance(found, dict):
        faults.append(f"{where}: not a mapping")
        return {}
    seen: dict[str, str] = {}
    for term, points in found.items():
        plain = normalize_one(term) if isinstance(term, str) else ""
        if not plain:
            faults.append(f"{where}: empty term {term!r}")
        elif plain in seen:
            faults.append(f"{where}: {term!r} is {seen[plain]!r} once normalised")
        if not number(points) or points * sign <= 0:
            faults.append(f"{where}: {term!r} needs a {'positive' if sign > 0 else 'negative'} number")
        seen.setdefault(plain, term)
    return {} if faults else {t: float(abs(p)) for t, p in found.items()}


def load_pack(text: str) -> tuple[Settings, list[Rule]]:
    """The settings and rules of a pack: settings, global_negative_phrases, and every category but the fallback one."""
    faults: list[str] = []
    root = exact(read(text), ("settings", "global_negative_phrases", "categories"), "pack", faults)
    settings = exact(root.get("settings", {}), NUMBERS, "settings", faults)
    for name, x in settings.items():
        least, itself = NUMBERS[name]
        if not number(x) or x < least or (x == least and not itself):
            faults.append(f"settings.{name}: needs a number of {'at least' if itself else 'more than'} {least}")
    if not faults and settings["title_weight"] <= settings["summary_weight"]:
        faults.append("settings.title_weight: must exceed summary_weight")
    negatives = _terms(root.get("global_negative_phrases", {}), -1, "global_negative_phrases", faults)
    named = [c for c in CATEGORIES if c not in ("unclassified", "irrelevant")]
    rules = []
    for name, body in exact(root.get("categories", {}), named, "categories", faults).items():
        body = exact(body, ("priority", *TERMS), name, faults)
        if not isinstance(body.get("priority", 0), int) or isinstance(body.get("priority"), bool):
            faults.append(f"{name}.priority: needs an integer")
        kinds = {k: _terms(body.get(k, {}), sign, f"{name}.{k}", faults) for k, sign in TERMS.items()}
        rules.append(Rule(name, body.get("priority", 0), *kinds.values()))
    if faults:
        raise PackError("\n".join(faults))
    return Settings(**{k: float(v) for k, v in settings.items()}, global_negatives=tuple(negatives.items())), sorted(rules, key=lambda r: CATEGORIES.index(r.category))


def pack_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A row for each term: category, priority, kind, term, points (negative ones with their sign)."""
    rows = [(r.category, r.priority, kind, term, sign * float(points)) for r in rules for kind, sign, terms in (("phrase", 1, r.phrases), ("keyword", 1, r.keywords), ("negative", -1, r.negatives)) for term, points in terms.items()]
    return spark.createDataFrame(rows, "category string, priority int, kind string, term string, points double")
