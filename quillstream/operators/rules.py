"""Rule classification: weighted terms, longest-match suppression, top two, margin, fallback, override.

Terms are normalised once on the driver.  with_hits() finds all of a pack's terms in one pass over a text
(operators/terms.py); the scores are Column expressions over what it finds, and no row multiplies.  The functions
also take plain text columns, which are then scanned once for each term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domains import CATEGORIES
from ..functions.text import contains_term, normalize_one
from .terms import Hits, term_hits


@dataclass(frozen=True)
class Settings:
    minimum_score: float = 8.0
    minimum_margin: float = 4.0
    title_weight: float = 2.0
    summary_weight: float = 1.0
    phrase_weight: float = 1.5
    global_negatives: tuple = (("disgusting", 8),)  #: (term, points taken)


@dataclass(frozen=True)
class Rule:
    category: str
    priority: int
    phrases: dict
    keywords: dict
    negatives: dict


#: Our own small rule pack over the words of the test corpus.
PACK = [
    Rule("model_technology", 60, {"of the": 4, "and the": 4}, {"thing": 3, "onthe": 3, "there": 2}, {"stupid": 6}),
    Rule("agent_product", 55, {"in the": 5, "to the": 4}, {"inin": 3, "edon": 4, "ther": 2}, {"trash": 6}),
    Rule("enterprise_case", 50, {"que los": 5, "de la": 5}, {"ción": 3, "mente": 3}, {}),
    Rule("award_case", 90, {"und der": 6, "der die": 5}, {"keit": 4, "schen": 3}, {"moron": 4}),
    Rule("solicitation", 100, {"les de": 6, "de les": 6}, {"ment": 3, "eaux": 4}, {}),
    Rule("policy_industry", 70, {"that the": 5, "with the": 5}, {"thand": 4, "ofthe": 4}, {"loser": 4}),
]
SETTINGS = Settings()
GLOBAL_NEGATIVES = dict(SETTINGS.global_negatives)


def pack_terms(pack: list[Rule], settings: Settings = SETTINGS) -> list[str]:
    """All terms of a pack, normalised."""
    return [normalize_one(t) for r in pack for terms in (r.phrases, r.keywords, r.negatives, dict(settings.global_negatives)) for t in terms]


def with_hits(df: DataFrame, title: Column, summary: Column, pack: list[Rule] = PACK, settings: Settings = SETTINGS) -> tuple[DataFrame, Hits, Hits]:
    """df with two more columns, and what stands for the title and the summary in the functions below."""
    terms = pack_terms(pack, settings)
    df, first = term_hits(df, "_title_hits", terms, title)
    df, second = term_hits(df, "_summary_hits", terms, summary)
    return df, first, second


def _has(text: Column | Hits, term: str) -> Column:
    return text.has(term) if isinstance(text, Hits) else contains_term(text, term)


def _alive(candidates: list[tuple[str, float, bool]], text: Column | Hits) -> list[tuple[str, float, bool, Column]]:
    """The terms, longest first and phrases before keywords of a length, with a test of whether each counts: a term that
    matches does not where its text lies in another matching one that does."""
    kept: list[tuple[str, float, bool, Column]] = []
    for term, points, phrase in sorted(candidates, key=lambda c: (-len(c[0]), not c[2])):
        alive = _has(text, term)
        for other, _, _, on in kept:
            if term in other:
                alive = alive & ~on
        kept.append((term, points, phrase, alive))
    return kept


def contributions(rule: Rule, title: Column | Hits, summary: Column | Hits, settings: Settings = SETTINGS) -> list[tuple[str, float, Column]]:
    """What each term of a rule adds where its test holds, in order: by field, positives before negatives.

    title and summary are normalised; negatives weigh by field only and never suppress each other."""
    positive = [(normalize_one(t), float(p), True) for t, p in rule.phrases.items()] + [(normalize_one(t), float(p), False) for t, p in rule.keywords.items()]
    out = []
    for field, text, weight in (("title", title, settings.title_weight), ("summary", summary, settings.summary_weight)):
        for term, points, phrase, alive in _alive(positive, text):
            out.append((f"{field}.{'phrase' if phrase else 'keyword'}:{term}", points * weight * (settings.phrase_weight if phrase else 1.0), alive))
        for term, points in (dict(settings.global_negatives) | rule.negatives).items():
            out.append((f"{field}.negative:{normalize_one(term)}", -points * weight, _has(text, normalize_one(term))))
    return out


def category_score(rule: Rule, title: Column | Hits, summary: Column | Hits, settings: Settings = SETTINGS) -> Column:
    total = F.lit(0.0)
    for _, points, test in contributions(rule, title, summary, settings):
        total = total + F.when(test, F.lit(float(points))).otherwise(0.0)
    return total


def explanations(rule: Rule, title: Column | Hits, summary: Column | Hits, settings: Settings = SETTINGS) -> Column:
    """The terms that counted, each as category.field.kind:term (+points)."""
    return F.array_compact(F.array(*[F.when(test, F.lit(f"{rule.category}.{what} ({points:+.2f})")) for what, points, test in contributions(rule, title, summary, settings)]))


def scores(title: Column | Hits, summary: Column | Hits, pack: list[Rule] = PACK, settings: Settings = SETTINGS) -> Column:
    """Array of (score, priority, order, category), the best first; equal ones stay in declaration order."""
    each = [F.struct(category_score(r, title, summary, settings).alias("score"), F.lit(r.priority).alias("priority"), F.lit(-CATEGORIES.index(r.category)).alias("turn"), F.lit(r.category).alias("category")) for r in pack]
    return F.sort_array(F.array(*each), asc=False)


def decide(ranked: Column, default: Column | None = None, settings: Settings = SETTINGS) -> Column:
    """category, score, provider and is_ambiguous from the ranked scores."""
    top, second = ranked[0], ranked[1]
    default = F.lit(None).cast("string") if default is None else default
    low = top["score"] < settings.minimum_score
    close = top["score"] - second["score"] < settings.minimum_margin
    category = F.when(low, F.coalesce(default, F.lit("unclassified"))).when(close, "unclassified").otherwise(top["category"])
    provider = F.when(low & default.isNotNull(), "source_default").otherwise("rule_based")
    return F.struct(category.alias("category"), top["score"].alias("score"), provider.alias("provider"), (~low & close).alias("is_ambiguous"))


def hybrid(rule: Column, model: Column) -> Column:
    """The rules' result where it is certain, else a model's with enough confidence, else the rules'.  model: (category, confidence)."""
    certain = ~rule["is_ambiguous"] & (rule["category"] != "unclassified")
    usable = (model["category"] != "unclassified") & (model["confidence"] >= 0.7)
    return F.when(certain | ~F.coalesce(usable, F.lit(False)), rule["category"]).otherwise(model["category"])


def reclassified(items: DataFrame, result: Column, why: Column, source_id: int | None = None) -> DataFrame:
    """items, of one source if it is given, with the result of decide() in place of the automatic category, its score,
    reason and provider, and `changed`, whether the category is another now.

    What was set by hand stands in manual_category and stays, so the effective category may not change."""
    rows = items if source_id is None else items.filter(F.col("source_id") == source_id)
    changed = ~F.col("category").eqNullSafe(result["category"])
    return rows.withColumns({"changed": changed, "category": result["category"], "classification_score": result["score"], "classification_reason": why, "automatic_category_provider": result["provider"]})
