"""Role-scoped taxonomy, tags, cases, verification, publication and re-classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domains import INDUSTRIES, TOPICS
from ..functions.urls import host, is_http_url
from .terms import Hits, term_hits


@dataclass(frozen=True)
class RoleRule:
    id: str
    role: str
    priority: int
    primary_type: str
    subjects: tuple = ()
    actions: tuple = ()
    excludes: tuple = ()
    topics: tuple = ()


#: Our own rules over the words of the test corpus.
RULES = [
    RoleRule("product.launch", "official_product", 90, "product_update", ("the", "thing"), ("and",), ("stupid",), ("model", "api")),
    RoleRule("product.case", "official_product", 90, "case_analysis", ("que",), (), (), ("case",)),
    RoleRule("policy.text", "official_policy", 80, "policy_standard", ("the", "und", "les"), (), ("trash",), ("policy",)),
    RoleRule("policy.report", "official_policy", 60, "report_release", ("that",), ("with",), (), ("standard",)),
    RoleRule("industry.report", "official_industry", 70, "report_release", ("with", "mente"), (), (), ("industry_application",)),
    RoleRule("industry.award", "official_industry", 70, "award_result", ("keit",), ("der",), (), ("award",)),
    RoleRule("hub.award", "opportunity_and_award_hub", 75, "award_result", ("that", "der"), (), (), ("award",)),
    RoleRule("hub.call", "opportunity_and_award_hub", 85, "application_opportunity", ("les", "los", "for"), ("to", "de"), (), ()),
    RoleRule("case.any", "official_case_hub", 50, "case_analysis", (), (), ("loser",), ("case",)),
    RoleRule("report.any", "report_hub", 65, "report_release", ("the", "der"), ("of", "die"), (), ("standard",)),
    RoleRule("media.signal", "media_discovery", 40, "industry_signal", ("on",), ("th",), (), ()),
]
TOPIC_TERMS = {"model": ["thing"], "agent": ["edon"], "api": ["inin"], "open_source": ["thand"], "policy": ["that the"], "standard": ["with the"], "award": ["keit"], "case": ["mente"], "safety_governance": ["disgusting"]}
INDUSTRY_TERMS = {"government": ["ofthe"], "finance": ["eaux"], "energy": ["ción"], "transport": ["erth"], "education": ["schen"]}
CASE_SIGNALS = ("thing", "keit", "los ")
CASE_DIMENSIONS = {"A": ("the ", "der "), "B": ("and ", "und "), "C": ("with", "mit"), "D": ("ther", "schen"), "E": ("eaux", "mente")}
VERSION = "v2"
TRUSTED = ["official_confirmed", "official_linked", "multi_source_confirmed"]
RUMOR = r"(?iU)\b(rumou?r|reportedly|idiot)\b|传闻"


@dataclass(frozen=True)
class Tags:
    """The terms of each topic and industry."""

    topics: dict[str, list[str]]
    industries: dict[str, list[str]]


TAGS = Tags(TOPIC_TERMS, INDUSTRY_TERMS)


def all_terms(rules: list[RoleRule] = RULES, tags: Tags = TAGS) -> list[str]:
    """What any of the functions below looks for in a text."""
    parts = [t for r in rules for t in (*r.subjects, *r.actions, *r.excludes)] + [t for terms in (*tags.topics.values(), *tags.industries.values(), *CASE_DIMENSIONS.values()) for t in terms]
    return [*parts, *CASE_SIGNALS]


def with_hits(df: DataFrame, title: Column, summary: Column, rules: list[RoleRule] = RULES, tags: Tags = TAGS) -> tuple[DataFrame, Hits]:
    """df with one more column, and what stands for the normalised title and summary in the functions below."""
    return term_hits(df, "_content_hits", all_terms(rules, tags), title, summary, bordered=False)


def _any(text: Column | Hits, terms) -> Column:
    if isinstance(text, Hits):
        return text.any(terms)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def content(title: Column, summary: Column) -> Column:
    """Normalised title and summary with a blank between."""
    return F.concat_ws(" ", title, summary)


def matches(rule: RoleRule, role: Column, text: Column | Hits) -> Column:
    return (role == rule.role) & ~_any(text, rule.excludes) & (_any(text, rule.subjects) if rule.subjects else F.lit(True)) & (_any(text, rule.actions) if rule.actions else F.lit(True))


def classified(df: DataFrame, role: Column, text: Column | Hits, rules: list[RoleRule] = RULES, tags: Tags = TAGS) -> DataFrame:
    """df with column t, see classify; the matching rules are found once a row."""
    return df.withColumn("_hit", hits(role, text, rules)).withColumn("t", classify(F.col("_hit"), text, tags)).drop("_hit")


def hits(role: Column, text: Column | Hits, rules: list[RoleRule] = RULES) -> Column:
    """The rules that match, with their priority, type and topics."""
    return F.array_compact(F.array(*[F.when(matches(r, role, text), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.primary_type).alias("type"), F.lit(r.id).alias("id"), F.lit(",".join(r.topics)).alias("topics"))) for r in rules]))


def classify(hit: Column, text: Column | Hits, tags: Tags = TAGS) -> Column:
    """primary_type, score, reason and tags from the matching rules: those of the highest priority must agree on one type."""
    top = F.array_max(F.transform(hit, lambda h: h["priority"]))
    types = F.array_distinct(F.transform(F.filter(hit, lambda h: h["priority"] == top), lambda h: h["type"]))
    one = F.size(types) == 1
    kind = F.when(one, F.get(types, F.lit(0))).otherwise("unclassified")
    reason = F.when(F.size(hit) == 0, "taxonomy.no_match").when(~one, "taxonomy.conflict_safe_unclassified").otherwise("taxonomy.rule")
    from_rules = F.flatten(F.transform(hit, lambda h: F.split(h["topics"], ",")))
    from_terms = F.array_compact(F.array(*[F.when(_any(text, terms), F.lit(t)) for t, terms in tags.topics.items()]))
    both = F.array_union(from_rules, from_terms)
    industries = F.array_compact(F.array(*[F.when(_any(text, tags.industries.get(t, [])), F.lit(t)) for t in INDUSTRIES]))
    return F.struct(
        kind.alias("primary_type"),
        F.when(one, F.least(F.lit(1.0), 0.6 + top / 250)).otherwise(0.0).alias("score"),
        reason.alias("reason"),
        F.filter(F.array(*[F.lit(t) for t in TOPICS]), lambda t: F.array_contains(both, t)).alias("topics"),
        industries.alias("industries"),
    )


def case_completeness(signal: Column, dims: dict[str, Column], detailed: Column) -> Column:
    """dims A to E; without fetched details a case is a lead at most."""
    n = sum((F.when(dims[k], 1).otherwise(0) for k in "ABCDE"), F.lit(0))
    full = (n >= 3) & (dims["D"] | dims["E"])
    return (
        F.when(~detailed, F.when(signal, "case_lead").otherwise("not_case"))
        .when(full, "full_case").when(signal & (dims["A"] | dims["B"] | dims["C"]), "partial_case").when(signal, "case_lead").otherwise("not_case")
    )


def case_state(kind: Column, text: Column | Hits, detailed: Column) -> Column:
    """case_completeness of an item of this type; only cases and awards have a signal."""
    signal = kind.isin("case_analysis", "award_result") & _any(text, CASE_SIGNALS)
    return case_completeness(signal, {k: _any(text, terms) for k, terms in CASE_DIMENSIONS.items()}, detailed)


def differs(stored: dict[str, Column], fresh: dict[str, Column]) -> Column:
    """Whether a classification changes anything that is stored: type, topics, industries, case completeness or version.

    Nulls are equal to each other."""
    return F.reduce(F.array(*[~stored[k].eqNullSafe(fresh[k]) for k in ("primary_type", "topics", "industries", "case_completeness", "version")]), F.lit(False), lambda a, x: a | x)


def reclassified(items: DataFrame, stored: dict[str, Column], fresh: dict[str, Column], more: dict[str, Column]) -> DataFrame:
    """items with `changed`, and where it holds the fresh values of the five compared columns and of `more`; what was
    set by hand stands in other columns and stays."""
    rows = items.withColumn("changed", differs(stored, fresh))
    return rows.withColumns({c: F.when(F.col("changed"), v).otherwise(stored.get(c, F.col(c) if c in items.columns else F.lit(None))) for c, v in (fresh | more).items()})


def verify(role: Column, text: Column | Hits, official_url: Column, url: Column, policy: Column) -> Column:
    """verification_status and review_status."""
    media = role == "media_discovery"
    linked = F.coalesce(is_http_url(official_url) & (host(official_url) != host(url)), F.lit(False))
    status = F.when(~media, "official_confirmed").when(text.rlike(RUMOR), "rumor_or_prediction").when(linked, "official_linked").otherwise("media_only")
    review = F.when(~media & (policy == "auto_publish"), "not_required").otherwise("pending")
    return F.struct(status.alias("verification_status"), review.alias("review_status"))


def publication(source: dict[str, Column], accepted: Column, kind: Column, verification: Column, review: Column) -> Column:
    """Where an item may be published, and the reasons against, in order.

    source: lifecycle, enabled, role, policy, homepage_visible, export_visible, and allowed (whether it takes items of this kind)."""
    active = (source["lifecycle"] == "active") & source["enabled"]
    against = {
        "source.not_active": ~active,
        "admission.rejected": ~accepted,
        "source.primary_type_not_allowed": ~source["allowed"],
        "verification.not_trusted": ~verification.isin(TRUSTED),
        "review.not_approved": ~review.isin("not_required", "approved"),
        "taxonomy.not_formal": kind.isin("unclassified", "industry_signal"),
        "source.never_publish": source["policy"] == "never_publish",
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in against.items()]))
    ready = F.size(reasons) == 0
    lead = (source["role"] == "media_discovery") | (kind == "industry_signal") | (review == "pending")
    return F.struct(
        (ready & source["homepage_visible"]).alias("homepage"),
        (ready & source["export_visible"]).alias("export"),
        (active & accepted & lead).alias("leads"),
        (active & accepted & (review == "pending")).alias("queue"),
        reasons.alias("reasons"),
    )


def smart_review_risk(confidence: Column, category: Column, groups: Column, title: Column, summary: Column, event_verbs: str, ranking: str) -> Column:
    """Points for a second look; items without a summary get none."""
    points = (
        F.when(confidence < 0.75, 3).otherwise(0) + F.when(category == "unclassified", 3).otherwise(0) + F.when(groups > 1, 3).otherwise(0)
        + F.when(~title.rlike(event_verbs), 1).otherwise(0) + F.when(F.length(title) < 12, 1).otherwise(0) + F.when(title.rlike(ranking), 2).otherwise(0)
    )
    return F.when(F.coalesce(summary, F.lit("")) == "", 0).otherwise(points)
