"""Admission, rule and taxonomy queries (ADM-*, AI-4, CLS-*, TAX-*; TAX-6 and TAX-11 are in intake_queries) over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import admission as A
from ..operators import rules as R
from ..operators import taxonomy as X2
from ..operators.terms import spread
from . import fixtures as X
from ..sources.rule_packs import load_pack
from .registry import query

_N = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_TEXTS = f"texts AS (SELECT i.*, {_N.format('i.title')} AS nt, {_N.format('coalesce(i.summary, chr(32))')} AS ns FROM items i)"


def _texts(spark, d):
    return spread(X.items(spark, d)).withColumns({"nt": T.normalize_text(F.col("title")), "ns": T.normalize_text(F.col("summary"))})


def _term(field: str, term: str) -> str:
    import re

    if re.fullmatch(r"[a-z0-9][a-z0-9+.#/-]*", term):
        return f"regexp_matches({field}, '(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)')"
    return f"contains({field}, '{term}')"


def _score(rule: R.Rule) -> str:
    parts = []
    terms = [(t, p, True) for t, p in rule.phrases.items()] + [(t, p, False) for t, p in rule.keywords.items()]
    terms.sort(key=lambda c: (-len(c[0]), not c[2]))
    for field, weight in (("nt", 2), ("ns", 1)):
        kept: list[tuple[str, str]] = []
        for term, points, phrase in terms:
            alive = _term(field, term) + "".join(f" AND NOT ({on})" for other, on in kept if term in other)
            kept.append((term, alive))
            parts.append(f"CASE WHEN {alive} THEN {points * weight * (1.5 if phrase else 1.0)} ELSE 0 END")
        for term, points in (R.GLOBAL_NEGATIVES | rule.negatives).items():
            parts.append(f"CASE WHEN {_term(field, term)} THEN {-points * weight} ELSE 0 END")
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


_SCORES = ", ".join(f"{_score(r)} AS {r.category}" for r in R.PACK)
_LONG = " UNION ALL ".join(f"SELECT id, source_id, category AS own, {r.category} AS score, {r.priority} AS priority, {i} AS turn, '{r.category}' AS category FROM scored" for i, r in enumerate(R.PACK))
_RANKED = f"{_TEXTS}, scored AS (SELECT id, source_id, category, {_SCORES} FROM texts), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, priority DESC, turn) AS k FROM ({_LONG}))"
_DECIDED = f"""{_RANKED}, decided AS (SELECT a.id, a.source_id, a.own, a.score, CASE WHEN a.score < 8 THEN 'unclassified' WHEN a.score - b.score < 4 THEN 'unclassified' ELSE a.category END AS category,
a.score >= 8 AND a.score - b.score < 4 AS is_ambiguous FROM ranked a JOIN ranked b ON a.id = b.id AND a.k = 1 AND b.k = 2)"""


def _scanned(spark, d, pack=R.PACK, settings=R.SETTINGS):
    return R.with_hits(spread(X.items(spark, d)), F.col("title"), F.col("summary"), pack, settings)


def _decided(spark, d):
    # the ranking is a column of its own, so that what reads it several times does not compute it as often
    rows, title, summary = _scanned(spark, d)
    return rows.withColumn("ranked", R.scores(title, summary)).withColumn("r", R.decide(F.col("ranked")))


@query("rule_scores", X.WITH + f", {_TEXTS} SELECT id, {_SCORES} FROM texts")
def rule_scores(spark, d):
    rows, title, summary = _scanned(spark, d)
    return rows.select("id", *[R.category_score(r, title, summary).alias(r.category) for r in R.PACK])


def _explained(rule: R.Rule) -> str:
    """Built from the pack's own terms, as _score is: the texts of what counts, in order."""
    parts = []
    terms = [(t, p, True) for t, p in rule.phrases.items()] + [(t, p, False) for t, p in rule.keywords.items()]
    terms.sort(key=lambda c: (-len(c[0]), not c[2]))
    for field, name, weight in (("nt", "title", 2), ("ns", "summary", 1)):
        kept: list[tuple[str, str]] = []
        for term, points, phrase in terms:
            alive = _term(field, term) + "".join(f" AND NOT ({on})" for other, on in kept if term in other)
            kept.append((term, alive))
            parts.append(f"CASE WHEN {alive} THEN '{rule.category}.{name}.{'phrase' if phrase else 'keyword'}:{term} (+{points * weight * (1.5 if phrase else 1.0):.2f})' END")
        for term, points in (R.GLOBAL_NEGATIVES | rule.negatives).items():
            parts.append(f"CASE WHEN {_term(field, term)} THEN '{rule.category}.{name}.negative:{term} (-{points * weight:.2f})' END")
    return f"concat_ws('、', {', '.join(parts)})"


@query("rule_explanations", X.WITH + f", {_TEXTS} SELECT id, {_explained(R.PACK[0])} AS first, {_explained(R.PACK[3])} AS fourth FROM texts")
def rule_explanations(spark, d):
    rows, title, summary = _scanned(spark, d)
    why = lambda rule: F.array_join(R.explanations(rule, title, summary), "、")
    return rows.select("id", why(R.PACK[0]).alias("first"), why(R.PACK[3]).alias("fourth"))


@query("rule_top2_margin", X.WITH + f", {_DECIDED} SELECT id, category, score, is_ambiguous FROM decided")
def rule_top2_margin(spark, d):
    return _decided(spark, d).select("id", "r.category", "r.score", "r.is_ambiguous")


@query("classification_summary", X.WITH + f", {_DECIDED} SELECT source_id, category, count(*) AS n, CAST(sum(CAST(score * 100 AS BIGINT)) AS BIGINT) AS score_cents FROM decided GROUP BY source_id, category")
def classification_summary(spark, d):
    rows = _decided(spark, d).select("source_id", "r.category", "r.score")
    return rows.groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") * 100).cast("long")).alias("score_cents"))


@query("classification_accuracy", X.WITH + f", {_DECIDED} SELECT own AS expected, count(*) AS n, count(*) FILTER (WHERE own = category) AS correct FROM decided GROUP BY own")
def classification_accuracy(spark, d):
    return _decided(spark, d).groupBy(F.col("category").alias("expected")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == F.col("r.category")).alias("correct"))


@query("manual_override", X.WITH + f", {_DECIDED} SELECT d.id, coalesce(i.manual_category, d.category) AS category, CASE WHEN i.manual_category IS NOT NULL THEN 'manual' ELSE 'automatic' END AS origin FROM decided d JOIN items i ON d.id = i.id")
def manual_override(spark, d):
    rows = _decided(spark, d)
    return rows.select("id", F.coalesce("manual_category", F.col("r.category")).alias("category"), F.when(F.col("manual_category").isNotNull(), "manual").otherwise("automatic").alias("origin"))


# every third source has a default for items that no rule fits
_DEFAULT = "CASE WHEN source_id % 3 = 0 THEN 'policy_industry' END"


@query(
    "rules_reclassified",
    X.WITH + f""", {_DECIDED}, r AS (SELECT d.id, i.source_id, i.category AS old, i.manual_category, d.score, CASE WHEN d.score < 8 THEN coalesce(CASE WHEN i.source_id % 3 = 0 THEN 'policy_industry' END, 'unclassified') ELSE d.category END AS category, CASE WHEN d.score < 8 AND i.source_id % 3 = 0 THEN 'source_default' ELSE 'rule_based' END AS provider FROM decided d JOIN items i ON i.id = d.id)
    SELECT id, category, score, provider, old <> category AS changed, coalesce(manual_category, category) AS effective FROM r""",
)
def rules_reclassified(spark, d):
    rows, title, summary = _scanned(spark, d)
    rows = rows.withColumn("ranked", R.scores(title, summary)).withColumn("r", R.decide(F.col("ranked"), F.expr(_DEFAULT)))
    out = R.reclassified(rows, F.col("r"), F.lit("by rules"))
    return out.select("id", "category", F.col("classification_score").alias("score"), F.col("automatic_category_provider").alias("provider"), "changed", F.coalesce("manual_category", "category").alias("effective"))


@query(
    "hybrid_categories",
    X.WITH + f""", {_DECIDED}, m AS (SELECT d.*, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'unclassified' ELSE own END AS model, (id % 10) / 10.0 AS confidence FROM decided d)
    SELECT id, CASE WHEN NOT is_ambiguous AND category <> 'unclassified' THEN category WHEN model <> 'unclassified' AND confidence >= 0.7 THEN model ELSE category END AS category FROM m""",
)
def hybrid_categories(spark, d):
    model = F.struct(F.when(F.col("id") % 5 == 1, "unclassified").when(F.col("id") % 5 != 0, F.col("category")).alias("category"), ((F.col("id") % 10) / 10.0).alias("confidence"))
    return _decided(spark, d).select("id", R.hybrid(F.col("r"), model).alias("category"))


def _sourced(spark, d):
    s = X.sources(spark, d)
    return _texts(spark, d).join(s.select(*[F.col(c).alias(f"s_{c}") for c in s.columns]), F.col("source_id") == F.col("s_id"))


def _classified(spark, d):
    rows, content = X2.with_hits(_sourced(spark, d), F.col("title"), F.col("summary"))
    return rows.transform(X2.classified, F.col("s_role"), content), content


def _content(spark, d):
    return _sourced(spark, d).withColumn("content", X2.content(F.col("nt"), F.col("ns")))


_CONTENT = f"{_TEXTS}, content AS (SELECT t.*, s.role AS s_role, s.policy AS s_policy, s.enabled AS s_enabled, s.allowed_types AS s_allowed, s.lifecycle AS s_lifecycle, s.homepage_visible AS s_homepage, s.export_visible AS s_export, concat_ws(' ', nt, ns) AS content FROM texts t JOIN sources s ON t.source_id = s.id)"


def _some(terms) -> str:
    return "(" + " OR ".join(f"contains(content, '{t}')" for t in terms) + ")"


def _hit(r) -> str:
    tests = [f"s_role = '{r.role}'"] + ([f"NOT {_some(r.excludes)}"] if r.excludes else []) + [_some(x) for x in (r.subjects, r.actions) if x]
    return " AND ".join(tests)


_HITS = " UNION ALL ".join(f"SELECT id, {r.priority} AS priority, '{r.primary_type}' AS type, '{','.join(r.topics)}' AS topics FROM content WHERE {_hit(r)}" for r in X2.RULES)
_TAX = f"""{_CONTENT}, hits AS ({_HITS}), best AS (SELECT h.id, max(h.priority) AS top, count(DISTINCT h.type) AS kinds, min(h.type) AS type FROM hits h JOIN (SELECT id, max(priority) AS p FROM hits GROUP BY id) m ON h.id = m.id AND h.priority = m.p GROUP BY h.id),
tax AS (SELECT c.id, c.source_id, CASE WHEN b.kinds = 1 THEN b.type ELSE 'unclassified' END AS type, CASE WHEN b.kinds = 1 THEN least(1.0, 0.6 + b.top / 250.0) ELSE 0.0 END AS score,
CASE WHEN b.id IS NULL THEN 'taxonomy.no_match' WHEN b.kinds > 1 THEN 'taxonomy.conflict_safe_unclassified' ELSE 'taxonomy.rule' END AS reason FROM content c LEFT JOIN best b ON c.id = b.id)"""


@query("taxonomy_primary_type", X.WITH + f", {_TAX} SELECT id, type AS primary_type, CAST(round(score * 1000) AS BIGINT) AS score_mille, reason FROM tax")
def taxonomy_primary_type(spark, d):
    rows, _ = _classified(spark, d)
    return rows.select("id", "t.primary_type", F.round(F.col("t.score") * 1000).cast("long").alias("score_mille"), "t.reason")


def _tags(order: list[str], terms: dict, from_rules: bool) -> str:
    tests = []
    for t in order:
        own = [f"contains(content, '{x}')" for x in terms.get(t, [])]
        if from_rules:
            own += [f"({_hit(r)})" for r in X2.RULES if t in r.topics]
        if own:
            tests.append(f"CASE WHEN {' OR '.join(own)} THEN '{t}' END")
    return f"concat_ws(',', {', '.join(tests)})"


@query("taxonomy_tags", X.WITH + f", {_CONTENT} SELECT id, {_tags(X2.TOPICS, X2.TOPIC_TERMS, True)} AS topics, {_tags(X2.INDUSTRIES, X2.INDUSTRY_TERMS, False)} AS industries FROM content")
def taxonomy_tags(spark, d):
    rows, _ = _classified(spark, d)
    return rows.select("id", F.array_join("t.topics", ",").alias("topics"), F.array_join("t.industries", ",").alias("industries"))


_STORED = {"topics": "CASE WHEN id % 2 = 0 THEN 'model,api' ELSE '' END", "industries": "CASE WHEN id % 12 = 5 THEN 'finance' ELSE '' END", "case_completeness": "CASE WHEN id % 14 = 3 THEN 'case_lead' ELSE 'not_case' END"}


def _case_sql() -> str:
    signal = f"(type IN ('case_analysis', 'award_result') AND {_some(X2.CASE_SIGNALS)})"
    dims = {k: _some(w) for k, w in X2.CASE_DIMENSIONS.items()}
    n = " + ".join(f"CAST({t} AS INTEGER)" for t in dims.values())
    return f"""CASE WHEN id % 3 = 0 AND {n} >= 3 AND ({dims['D']} OR {dims['E']}) THEN 'full_case' WHEN id % 3 = 0 AND {signal} AND ({dims['A']} OR {dims['B']} OR {dims['C']}) THEN 'partial_case'
    WHEN {signal} THEN 'case_lead' ELSE 'not_case' END"""


_FRESH = f"""{_TAX}, tags AS (SELECT id, {_tags(X2.TOPICS, X2.TOPIC_TERMS, True)} AS topics, {_tags(X2.INDUSTRIES, X2.INDUSTRY_TERMS, False)} AS industries FROM content),
fresh AS (SELECT id, type, topics, industries, {_case_sql()} AS case_completeness FROM (SELECT t.id, t.type, g.topics, g.industries, c.content FROM tax t JOIN tags g ON t.id = g.id JOIN content c ON t.id = c.id))"""


def _fresh(spark, d):
    """The items with t, the classification, and its case completeness; every third has its details fetched."""
    rows, content = _classified(spark, d)
    return rows.withColumn("fresh_case", X2.case_state(F.col("t.primary_type"), content, F.col("id") % 3 == 0))


@query("case_states", X.WITH + f", {_FRESH} SELECT id, case_completeness FROM fresh")
def case_states(spark, d):
    return _fresh(spark, d).select("id", F.col("fresh_case").alias("case_completeness"))


@query(
    "reclassify_diff",
    X.WITH
    + f""", {_FRESH} SELECT count(*) AS total, count(*) FILTER (WHERE i.primary_type <> f.type OR i.topics <> f.topics OR i.industries <> f.industries OR i.case_completeness <> f.case_completeness OR i.taxonomy_version <> 'v2') AS changed,
    count(*) FILTER (WHERE coalesce(i.manual_primary_type, f.type) = 'unclassified') AS unclassified, count(i.manual_primary_type) AS preserved_manual FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STORED.items())} FROM items) i JOIN fresh f ON i.id = f.id""",
)
def reclassify_diff(spark, d):
    stored = {n: F.expr(e) for n, e in _STORED.items()} | {"primary_type": F.col("primary_type"), "version": F.col("taxonomy_version")}
    fresh = {"primary_type": F.col("t.primary_type"), "topics": F.array_join("t.topics", ","), "industries": F.array_join("t.industries", ","), "case_completeness": F.col("fresh_case"), "version": F.lit(X2.VERSION)}
    return _fresh(spark, d).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(X2.differs(stored, fresh)).alias("changed"),
        F.count_if(F.coalesce("manual_primary_type", F.col("t.primary_type")) == "unclassified").alias("unclassified"), F.count("manual_primary_type").alias("preserved_manual"),
    )


@query(
    "reclassify_applied",
    X.WITH
    + f""", {_FRESH}, j AS (SELECT i.*, f.type AS f_type, f.topics AS f_topics, f.industries AS f_industries, f.case_completeness AS f_case, i.primary_type <> f.type OR i.topics <> f.topics OR i.industries <> f.industries OR i.case_completeness <> f.case_completeness OR i.taxonomy_version <> 'v2' AS changed
    FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _STORED.items())} FROM items) i JOIN fresh f ON i.id = f.id)
    SELECT j.id, changed, f_type AS primary_type, f_topics AS topics, f_industries AS industries, f_case AS case_completeness, 'v2' AS version, CASE WHEN changed THEN tax.reason ELSE 'as it was' END AS reason, manual_primary_type FROM j JOIN tax ON tax.id = j.id""",
)
def reclassify_applied(spark, d):
    rows = _fresh(spark, d).withColumns({n: F.expr(e) for n, e in _STORED.items()} | {"version": F.col("taxonomy_version"), "reason": F.lit("as it was")})
    stored = {n: F.col(n) for n in ("primary_type", *_STORED, "version")}
    fresh = {"primary_type": F.col("t.primary_type"), "topics": F.array_join("t.topics", ","), "industries": F.array_join("t.industries", ","), "case_completeness": F.col("fresh_case"), "version": F.lit(X2.VERSION)}
    out = X2.reclassified(rows, stored, fresh, {"reason": F.col("t.reason")})
    return out.select("id", "changed", "primary_type", "topics", "industries", "case_completeness", "version", "reason", "manual_primary_type")


_PACK_WORDS = [("model_technology", "of the", "with"), ("agent_product", "in the", "that"), ("enterprise_case", "de la", "los"), ("award_case", "und der", "die"), ("solicitation", "les de", "des"), ("policy_industry", "to the", "for")]
# a pack as it is loaded, over neutral words: other weights and limits than the built-in one
_PACK_TEXT = """
settings: {minimum_score: 5, minimum_margin: 2, title_weight: 3, summary_weight: 1, phrase_weight: 2}
global_negative_phrases: {"lost in": -4}
categories:
""" + "\n".join(f"  {c}: {{priority: {50 + i}, phrases: {{\"{p}\": {3 + i}}}, keywords: {{\"{k}\": 2}}, negative_phrases: {{}}}}" for i, (c, p, k) in enumerate(_PACK_WORDS))
_LOADED = load_pack(_PACK_TEXT)


def _loaded_score(rule: R.Rule) -> str:
    parts = []
    for field, weight in (("nt", 3), ("ns", 1)):
        parts += [f"CASE WHEN {_term(field, t)} THEN {p * weight * 2} ELSE 0 END" for t, p in rule.phrases.items()]
        parts += [f"CASE WHEN {_term(field, t)} THEN {p * weight} ELSE 0 END" for t, p in rule.keywords.items()]
        parts.append(f"CASE WHEN {_term(field, 'lost in')} THEN {-4 * weight} ELSE 0 END")
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


@query("loaded_pack_scores", X.WITH + f", {_TEXTS} SELECT id, {', '.join(f'{_loaded_score(r)} AS {r.category}' for r in _LOADED[1])} FROM texts")
def loaded_pack_scores(spark, d):
    settings, rules = _LOADED
    rows, title, summary = _scanned(spark, d, rules, settings)
    return rows.select("id", *[R.category_score(r, title, summary, settings).alias(r.category) for r in rules])


_LINK = "CASE WHEN id % 3 = 0 THEN 'https://official.example/a' WHEN id % 3 = 1 THEN 'https://media.example/b' END"


@query(
    "verification_status",
    X.WITH
    + f""", {_CONTENT} SELECT id, CASE WHEN s_role <> 'media_discovery' THEN 'official_confirmed' WHEN regexp_matches(content, '\\b(rumou?r|reportedly|idiot)\\b') THEN 'rumor_or_prediction' WHEN id % 3 = 0 THEN 'official_linked' ELSE 'media_only' END AS verification_status,
    CASE WHEN s_role <> 'media_discovery' AND s_policy = 'auto_publish' THEN 'not_required' ELSE 'pending' END AS review_status FROM content""",
)
def verification_status(spark, d):
    v = X2.verify(F.col("s_role"), F.col("content"), F.expr(_LINK), F.lit("https://media.example/x"), F.col("s_policy"))
    return _content(spark, d).select("id", v.alias("v")).select("id", "v.*")


_ACTIVE = "(s_lifecycle = 'active' AND s_enabled)"
_AGAINST = f"""concat_ws(',', CASE WHEN NOT {_ACTIVE} THEN 'source.not_active' END, CASE WHEN NOT admission_accepted THEN 'admission.rejected' END,
CASE WHEN NOT (s_allowed = '' OR list_contains(string_split(s_allowed, ','), primary_type)) THEN 'source.primary_type_not_allowed' END,
CASE WHEN verification_status NOT IN ('official_confirmed', 'official_linked', 'multi_source_confirmed') THEN 'verification.not_trusted' END, CASE WHEN review_status NOT IN ('not_required', 'approved') THEN 'review.not_approved' END,
CASE WHEN primary_type IN ('unclassified', 'industry_signal') THEN 'taxonomy.not_formal' END, CASE WHEN s_policy = 'never_publish' THEN 'source.never_publish' END)"""


@query(
    "publication_reasons",
    X.WITH
    + f""", {_CONTENT} SELECT id, reasons, reasons = '' AND s_homepage AS homepage, reasons = '' AND s_export AS export,
    {_ACTIVE} AND admission_accepted AND (s_role = 'media_discovery' OR primary_type = 'industry_signal' OR review_status = 'pending') AS leads,
    {_ACTIVE} AND admission_accepted AND review_status = 'pending' AS queue FROM (SELECT *, {_AGAINST} AS reasons FROM content)""",
)
def publication_reasons(spark, d):
    from ..operators.items import allowed_type

    source = {k: F.col(f"s_{k}") for k in ("lifecycle", "enabled", "role", "policy", "homepage_visible", "export_visible")}
    source["allowed"] = allowed_type(F.col("s_allowed_types"), F.col("primary_type"))
    p = X2.publication(source, F.col("admission_accepted"), F.col("primary_type"), F.col("verification_status"), F.col("review_status"))
    rows = _content(spark, d).select("id", p.alias("p"))
    return rows.select("id", F.array_join("p.reasons", ",").alias("reasons"), "p.homepage", "p.export", "p.leads", "p.queue")


_VERBS, _RANK = "(the|and)", "(best|top)"


@query(
    "smart_review_risk",
    X.WITH
    + f"""SELECT id, CAST(CASE WHEN coalesce(summary, '') = '' THEN 0 ELSE CASE WHEN id % 10 < 7 THEN 3 ELSE 0 END + CASE WHEN category = 'unclassified' THEN 3 ELSE 0 END + CASE WHEN id % 4 > 1 THEN 3 ELSE 0 END
    + CASE WHEN NOT regexp_matches(title, '{_VERBS}') THEN 1 ELSE 0 END + CASE WHEN length(title) < 12 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '{_RANK}') THEN 2 ELSE 0 END END AS INTEGER) AS risk FROM items""",
)
def smart_review_risk(spark, d):
    risk = X2.smart_review_risk((F.col("id") % 10) / 9.0, F.col("category"), F.col("id") % 4, F.col("title"), F.col("summary"), _VERBS, _RANK)
    return X.items(spark, d).select("id", risk.alias("risk"))


def _admitted(spark, d):
    """The items with their admission, all role and release rejects included."""
    i = _sourced(spark, d)
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    src = {
        "valid": F.col("s_id") != 19, "site_host": F.lit("host.example"), "allow_external": F.col("s_id") % 2 == 0, "include_terms": F.when(F.col("s_id") % 5 == 1, words("the", "der", "les")).otherwise(none),
        "exclude_terms": F.when(F.col("s_id") % 4 == 1, words("STUPID", "trash")).otherwise(none), "scopes": F.when(F.col("s_id") % 6 == 2, words("policy_standard", "award_result")).otherwise(none), "formal": F.col("s_kind") == "formal",
        "tier": F.col("s_tier"), "role": F.col("s_role"), "title_only_allowed": F.col("s_id") % 3 == 0, "minimum": F.lit(48.5),
        "release": F.col("s_id") % 7 == 3, "technical": F.col("s_id") % 2 == 1,
    }
    url = F.when(F.col("id") % 23 == 0, "ftp://host.example/x").when(F.col("id") % 19 == 0, "https://other.example/x").when(F.col("id") % 29 == 0, "https://host.example/login").otherwise("https://host.example/x")
    return A.admitted(i, F.col("title"), F.col("summary"), url, F.col("published_at"), src)


def _admission_sql() -> str:
    def rx(p: str) -> str:
        """The second engine's word border is an ASCII one: spell out the Unicode border."""
        edge = r"[^\p{L}\p{N}_]"
        return p.replace("(?iU)", "(?i)").replace(r"\b", f"(?:^|{edge})", 1).replace(r"\b", f"(?:{edge}|$)", 1)

    when = ["s.id = 19 THEN 'source.configuration_invalid'", "trim(title) = '' THEN 'content.empty_title'", "i.id % 23 = 0 THEN 'content.invalid_url'", "NOT (s.id % 2 = 0) AND i.id % 19 = 0 THEN 'content.external_link_not_allowed'", "i.id % 19 <> 0 AND i.id % 29 = 0 THEN 'content.invalid_page_url'"]
    when += [f"regexp_matches(trim(title), '{rx(p)}') THEN '{n}'" for n, p in A.STRUCTURAL.items()]
    when += ["s.id % 4 = 1 AND (contains(lower(full_text), 'stupid') OR contains(lower(full_text), 'trash')) THEN 'source.exclude_term'"]
    when += [f"regexp_matches(full_text, '{rx(p)}') THEN '{n}'" for n, p in A.LOW_VALUE.items()]
    when += [f"regexp_matches(full_text, '{rx(A.MEETING)}') AND NOT regexp_matches(full_text, '{rx(A.SUBSTANCE)}') THEN 'content.ordinary_meeting'"]
    for role, (why, bad, saving) in A.ROLE.items():
        tests = [f"s.role = '{role}'"] + ([f"regexp_matches(full_text, '{bad}')"] if bad else []) + ([f"NOT regexp_matches(full_text, '{saving}')"] if saving else [])
        when += [f"{' AND '.join(tests)} THEN '{why}'"]
    part = lambda k: f"regexp_extract(full_text, '{A.SEMVER}', {k})"
    tests = {
        "prerelease": f"regexp_matches(full_text, '{A.PRERELEASE}')", "non_major_version": f"regexp_matches(concat({part(2)}, {part(3)}), '[1-9]')", "maintenance": f"regexp_matches(full_text, '{A.MAINTENANCE}')",
        "technical_updates_not_allowed": "s.id % 2 <> 1", "major_release_not_proven": f"NOT regexp_matches({part(1)}, '[1-9]')",
    }
    when += [f"s.id % 7 = 3 AND {t} THEN 'github.{k}'" for k, t in tests.items()] + ["s.id % 5 = 1 AND hits = 0 THEN 'source.include_term_missing'"]
    pos = [(k, f"regexp_matches(full_text, '{rx(p)}')", n) for k, (p, n) in A.POSITIVE.items()]
    score = "least(100, 15 + CASE s.tier WHEN 'government' THEN 10 WHEN 'official_company' THEN 8 WHEN 'association' THEN 7 WHEN 'authoritative_media' THEN 5 ELSE 0 END + CASE WHEN s.id % 5 = 1 THEN 20 * hits ELSE 0 END + CASE WHEN s.kind = 'formal' THEN 10 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 5 ELSE 0 END"
    score += f" + CASE WHEN published_at IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN regexp_matches(full_text, '{rx(A.RELEVANCE)}') THEN 15 ELSE 0 END" + "".join(f" + CASE WHEN {t} THEN {n} ELSE 0 END" for _, t, n in pos) + ")"
    some = " OR ".join(t for _, t, _ in pos)
    wanted = " OR ".join(t for k, t, _ in pos if k in ("policy_standard", "award_result"))
    soft = f"CASE WHEN s.id % 6 = 2 AND ({some}) AND NOT ({wanted}) THEN 'source.content_scope_mismatch' WHEN s.id % 3 <> 0 AND summary IS NULL THEN 'content.title_only_not_allowed' WHEN summary IS NULL AND length(title) < 6 AND NOT ({some}) THEN 'content.insufficient_substance' WHEN {score} < 48 THEN 'quality.below_minimum' ELSE 'quality.threshold_met' END"
    hits = "CAST(contains(lower(full_text), 'the') AS INTEGER) + CAST(contains(lower(full_text), 'der') AS INTEGER) + CAST(contains(lower(full_text), 'les') AS INTEGER)"
    base = f"(SELECT *, {hits} AS hits FROM (SELECT *, concat(title, chr(10), coalesce(summary, '')) AS full_text FROM items))"
    return f"SELECT i.id, hard IS NULL AND soft = 'quality.threshold_met' AS accepted, coalesce(hard, soft) AS reason, CAST(CASE WHEN hard IS NOT NULL THEN 0 ELSE score END AS INTEGER) AS quality_score FROM (SELECT i.id, CASE WHEN {' WHEN '.join(when)} END AS hard, {soft} AS soft, {score} AS score FROM {base} i JOIN sources s ON i.source_id = s.id) i"


@query("admission_decision", X.WITH + _admission_sql())
def admission_decision(spark, d):
    return _admitted(spark, d).select("id", "a.accepted", "a.reason", "a.quality_score")


@query("admission_histogram", X.WITH + f"SELECT reason, count(*) AS n, CAST(sum(quality_score) AS BIGINT) AS points FROM ({_admission_sql()}) GROUP BY reason")
def admission_histogram(spark, d):
    return _admitted(spark, d).groupBy("a.reason").agg(F.count(F.lit(1)).alias("n"), F.sum("a.quality_score").alias("points"))
