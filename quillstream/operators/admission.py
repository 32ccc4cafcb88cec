"""Admission: an ordered decision list with a reason, an additive score and an audit of what matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host, is_http_url
from .terms import Hits, pattern_hits

# Each pattern comes with words, in lower case, of which all its matches hold one: only texts with such a word are tried.
#: Our own patterns; the first that matches names the reason.
STRUCTURAL = {"content.navigation_page": r"(?iU)^(home|menu|sitemap|index)$", "content.login_page": r"(?iU)^(log ?in|sign ?in|register)$", "content.contact_page": r"(?iU)^(contact|about) us$"}
LOW_VALUE = {
    "content.recruitment": r"(?iU)\b(we are hiring|join our team|vacanc(y|ies))\b|招聘",
    "content.course": r"(?iU)\b(training course|webinar replay)\b|培训班",
    "content.advert": r"(?iU)\b(limited offer|buy now|discount)\b|优惠",
    "content.greeting": r"(?iU)\bhappy new year\b|节日快乐",
    "content.personnel": r"(?iU)\bappointed as\b|任命",
    "content.visit": r"(?iU)\bvisited the\b|调研",
    "content.stock": r"(?iU)\bshare price\b|股价",
    "content.empty_cooperation": r"(?iU)\bstrategic cooperation\b|战略合作",
}
MEETING, SUBSTANCE = r"(?iU)\b(meeting|forum|conference)\b|会议", r"(?iU)\b(released?|launch(ed)?|published|award(ed)?)\b|发布"
PAGE = r"(?i)/(login|signin|register|contact)(/|\.|\?|$)"
POSITIVE = {
    "product_update": (r"(?iU)\b(release|launch|version|update|thing)", 35),
    "policy_standard": (r"(?iU)\b(policy|standard|regulation|that)\b", 35),
    "report_release": (r"(?iU)\b(report|paper|with)\b", 30),
    "award_result": (r"(?iU)\b(award|winner|und)\b", 35),
    "case_analysis": (r"(?iU)\b(case|practice|los)\b", 35),
    "application_opportunity": (r"(?iU)\b(call for|tender|les)\b", 30),
}
WORDS = {
    "content.recruitment": ("we are hiring", "join our team", "vacanc", "招聘"),
    "content.course": ("training course", "webinar replay", "培训班"),
    "content.advert": ("limited offer", "buy now", "discount", "优惠"),
    "content.greeting": ("happy new year", "节日快乐"),
    "content.personnel": ("appointed as", "任命"),
    "content.visit": ("visited the", "调研"),
    "content.stock": ("share price", "股价"),
    "content.empty_cooperation": ("strategic cooperation", "战略合作"),
    "meeting": ("meeting", "forum", "conference", "会议"),
    "substance": ("release", "launch", "published", "award", "发布"),
    "product_update": ("release", "launch", "version", "update", "thing"),
    "policy_standard": ("policy", "standard", "regulation", "that"),
    "report_release": ("report", "paper", "with"),
    "award_result": ("award", "winner", "und"),
    "case_analysis": ("case", "practice", "los"),
    "application_opportunity": ("call for", "tender", "les"),
    "relevance": ("ai", "model", "agent", "the"),
    "official_product": ("峰会演讲", "参展", "展台", "亮相", "战略签约", "普通合作", "融资", "股价", "人物采访", "招聘", "使用教程", "优惠", "促销"),
    "official_policy": ("培训", "调研", "领导活动", "座谈会"),
    "official_industry saving": ("人工智能", "大模型", "智能体", "agent", "高质量数据集", "算力", "数据", "ai"),
    "opportunity_and_award_hub": ("通知",),
    "opportunity_and_award_hub saving": ("征集", "申报", "参评", "报名", "获奖", "入选", "名单", "公示", "政策", "标准", "报告"),
    "prerelease": ("alpha", "beta", "rc", "nightly", "pre"),
    "maintenance": ("bug", "fix", "patch", "dependenc", "依赖升级", "构建修复", "ci/cd", "文档修正", "changelog", "维护版本"),
}
RELEVANCE = r"(?iU)\b(ai|model|agent|the)\b"
TIER_POINTS = {"government": 10, "official_company": 8, "association": 7, "authoritative_media": 5}
# The patterns of the role rejects and of the rejects of code releases.
#: By role the reason and, of the content, what rejects it and what saves it (ADM-10).
ROLE = {
    "official_product": ("role.official_product.non_product_activity", r"峰会演讲|参展|展台|亮相|战略签约|普通合作|融资|股价|人物采访|招聘|使用教程|优惠|促销", None),
    "official_policy": ("role.official_policy.routine_activity", r"培训|调研|领导活动|座谈会", None),
    "official_industry": ("role.official_industry.ai_relevance_missing", None, r"(?i)人工智能|大模型|智能体|Agent|高质量数据集|算力|数据.{0,5}AI|AI.{0,5}应用|AI.{0,5}治理"),
    "opportunity_and_award_hub": ("role.opportunity_hub.generic_notice", r"通知", r"征集|申报|参评|报名|获奖|入选|名单|公示|政策|标准|报告"),
}
#: Rejects of code releases (ADM-11).
PRERELEASE = r"(?i)(?:^|[.\-_\s])(?:alpha|beta|rc|nightly|pre[- ]?release)(?:$|[.\-_\s\d])"
SEMVER = r"(?:^|\s|v)(\d+)\.(\d+)\.(\d+)(?:[-+][0-9A-Za-z.-]+)?"
MAINTENANCE = r"(?i)bug\s*fix|fix(?:es|ed)?(?:[^\p{L}\p{N}_]|$)|patch|dependency|dependencies|依赖升级|构建修复|CI/CD|文档修正|changelog|维护版本"


def _any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, F.lower(t)))


def patterns() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Every pattern that whole contents are tried for, with its words."""
    found = dict(LOW_VALUE) | {"meeting": MEETING, "substance": SUBSTANCE, "relevance": RELEVANCE, "prerelease": PRERELEASE, "maintenance": MAINTENANCE} | {k: p for k, (p, _) in POSITIVE.items()}
    for role, (_, bad, saving) in ROLE.items():
        found |= ({role: bad} if bad else {}) | ({f"{role} saving": saving} if saving else {})
    return {k: (p, WORDS[k]) for k, p in found.items()}


def role_reason(on: Hits, role: Column) -> Column:
    """Why a source's role rejects title and summary, null if it doesn't."""
    found = F.lit(None).cast("string")
    for name, (why, bad, saving) in ROLE.items():
        test = role == name
        if bad:
            test &= on.has(name)
        if saving:
            test &= ~on.has(f"{name} saving")
        found = F.when(test, why).otherwise(found)
    return found


def release_reason(on: Hits, content: Column, technical: Column) -> Column:
    """Why a code release is rejected: prerelease, minor version, maintenance, no technical updates wanted, no proven major release."""
    major, minor, patch = (F.regexp_extract(content, SEMVER, i) for i in (1, 2, 3))
    return (
        F.when(on.has("prerelease"), "github.prerelease")
        .when(minor.rlike("[1-9]") | patch.rlike("[1-9]"), "github.non_major_version")
        .when(on.has("maintenance"), "github.maintenance")
        .when(~technical, "github.technical_updates_not_allowed")
        .when(~major.rlike("[1-9]"), "github.major_release_not_proven")
    )


def admitted(df: DataFrame, title: Column, summary: Column, url: Column, published: Column, source: dict[str, Column], out: str = "a") -> DataFrame:
    """df with a struct of accepted, reason, quality_score and matched (rule ids) of each item.

    All patterns are tried in one pass over title and summary; intermediate results that are read more than once are
    columns of their own for a while.

    source: site_host, allow_external, include_terms, exclude_terms, scopes, formal, tier, role, title_only_allowed, minimum, valid, and
    release and technical: whether it is one of code releases and takes technical updates."""
    kept = df.columns
    df = df.withColumn("_full", F.concat_ws("\n", title, F.coalesce(summary, F.lit(""))))
    full = F.col("_full")
    text = F.lower(full)
    df, on = pattern_hits(df, "_on", patterns(), full)
    reason = F.when(~source["valid"], "source.configuration_invalid")
    reason = reason.when(F.trim(F.coalesce(title, F.lit(""))) == "", "content.empty_title").when(~is_http_url(url), "content.invalid_url")
    reason = reason.when(~source["allow_external"] & (host(url) != source["site_host"]), "content.external_link_not_allowed").when(url.rlike(PAGE), "content.invalid_page_url")
    for name, pattern in STRUCTURAL.items():
        reason = reason.when(F.trim(title).rlike(pattern), name)
    reason = reason.when(_any(text, source["exclude_terms"]), "source.exclude_term")
    for name in LOW_VALUE:
        reason = reason.when(on.has(name), name)
    reason = reason.when(on.has("meeting") & ~on.has("substance"), "content.ordinary_meeting")
    reason = F.coalesce(reason, role_reason(on, source["role"]), F.when(source["release"], release_reason(on, full, source["technical"])))
    reason = F.when(reason.isNotNull(), reason)
    hits = F.size(F.filter(source["include_terms"], lambda t: F.contains(text, F.lower(t))))
    reason = reason.when((F.size(source["include_terms"]) > 0) & (hits == 0), "source.include_term_missing")
    points = {
        "quality.formal": (source["formal"], 10),
        "quality.summary": (F.length(F.coalesce(summary, F.lit(""))) > 0, 5),
        "quality.date": (published.isNotNull(), 5),
        "quality.relevance": (on.has("relevance"), 15),
    } | {f"content.{k}": (on.has(k), n) for k, (_, n) in POSITIVE.items()}
    tier = F.lit(0)
    for name, n in TIER_POINTS.items():
        tier = F.when(source["tier"] == name, n).otherwise(tier)
    score = F.lit(15) + tier + 20 * hits
    for test, n in points.values():
        score = score + F.when(test, n).otherwise(0)
    score = F.least(F.lit(100), F.greatest(F.lit(0), score))
    scopes = F.array_compact(F.array(*[F.when(on.has(k), F.lit(k)) for k in POSITIVE]))
    df = df.withColumns({"_reason": reason, "_score": score, "_scopes": scopes})
    reason, score, scopes = F.col("_reason"), F.col("_score"), F.col("_scopes")
    final = (
        F.when((F.size(scopes) > 0) & (F.size(source["scopes"]) > 0) & ~F.arrays_overlap(scopes, source["scopes"]), "source.content_scope_mismatch")
        .when(~source["title_only_allowed"] & (F.coalesce(summary, F.lit("")) == ""), "content.title_only_not_allowed")
        .when((F.coalesce(summary, F.lit("")) == "") & (F.length(title) < 6) & (F.size(scopes) == 0), "content.insufficient_substance")
        .when(score < F.bround(source["minimum"]), "quality.below_minimum")
        .otherwise("quality.threshold_met")
    )
    df, final = df.withColumn("_final", final), F.col("_final")
    hard = reason.isNotNull()
    matched = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, (test, _) in points.items()]))
    result = F.struct(
        (~hard & (final == "quality.threshold_met")).alias("accepted"),
        F.coalesce(reason, final).alias("reason"),
        F.when(hard, 0).otherwise(score).cast("int").alias("quality_score"),
        F.when(hard, F.array().cast("array<string>")).otherwise(matched).alias("matched"),
    )
    return df.select(*kept, result.alias(out))
