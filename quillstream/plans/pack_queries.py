"""Items classified by taxonomy packs that are loaded from text (SRC-31, TAX-1 to TAX-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domains as D
from ..operators import taxonomy as X2
from ..sources.catalogs import load_role_pack, load_tags
from . import fixtures as X
from .classification_queries import _CONTENT, _sourced
from .registry import query

PACKS = {
    "official_policy": """
version: v2
role: official_policy
rules:
  - {id: policy.low, priority: 40, primary_type: report_release, subject_terms: [tion, from], action_terms: [], exclude_terms: [], topic_tags: []}
  - {id: policy.high, priority: 100, primary_type: policy_standard, subject_terms: [" That ", "this"], action_terms: [with, ther], exclude_terms: [from], topic_tags: [policy, agent]}
""",
    "report_hub": """
version: v2
role: report_hub
rules:
  - {id: report.one, priority: 60, primary_type: report_release, subject_terms: [that], action_terms: [], exclude_terms: [], topic_tags: [case]}
  - {id: report.two, priority: 60, primary_type: case_analysis, subject_terms: [with], action_terms: [], exclude_terms: [], topic_tags: []}
""",
    "media_discovery": "{version: v2, role: media_discovery, rules: [{id: media.all, priority: 100, primary_type: industry_signal, subject_terms: [], action_terms: [], exclude_terms: [], topic_tags: []}]}",
}
_TOPIC_WORDS = dict(zip(D.TOPICS, "that tion ther thes thed erin this with from erth eren thha".split(), strict=True))
_INDUSTRY_WORDS = dict(zip(D.INDUSTRIES[:-1], "that with this from tion ther thes eren thed thnt".split(), strict=True))
TAGS = "version: v2\n" + "".join(f"{key}:\n" + "".join(f"  {t}: [{w.upper()}]\n" for t, w in words.items()) for key, words in (("topic_tags", _TOPIC_WORDS), ("industry_tags", _INDUSTRY_WORDS)))

# written out by hand, not from the packs
_BY_HAND = """CASE WHEN s_role = 'media_discovery' THEN 'industry_signal' WHEN s_role = 'official_policy' AND NOT contains(content, 'from') AND (contains(content, 'that') OR contains(content, 'this')) AND (contains(content, 'with') OR contains(content, 'ther')) THEN 'policy_standard'
WHEN s_role = 'official_policy' AND (contains(content, 'tion') OR contains(content, 'from')) THEN 'report_release' WHEN s_role = 'report_hub' AND contains(content, 'that') AND contains(content, 'with') THEN 'conflict'
WHEN s_role = 'report_hub' AND contains(content, 'that') THEN 'report_release' WHEN s_role = 'report_hub' AND contains(content, 'with') THEN 'case_analysis' END"""
_MORE = {
    "agent": "s_role = 'official_policy' AND NOT contains(content, 'from') AND (contains(content, 'that') OR contains(content, 'this')) AND (contains(content, 'with') OR contains(content, 'ther'))",
    "case": "s_role = 'report_hub' AND contains(content, 'that')",
}
_MORE["policy"] = _MORE["agent"]
_tags = lambda words: "concat_ws(',', " + ", ".join(f"CASE WHEN contains(content, '{w}'){' OR (' + _MORE[t] + ')' if t in _MORE else ''} THEN '{t}' END" for t, w in words.items()) + ")"


@query(
    "taxonomy_loaded",
    X.WITH
    + f""", {_CONTENT} SELECT id, CASE WHEN kind IS NULL OR kind = 'conflict' THEN 'unclassified' ELSE kind END AS primary_type, CASE WHEN kind IS NULL THEN 'taxonomy.no_match' WHEN kind = 'conflict' THEN 'taxonomy.conflict_safe_unclassified' ELSE 'taxonomy.rule' END AS reason,
    CASE WHEN kind IN ('industry_signal', 'policy_standard') THEN 1000 WHEN s_role = 'official_policy' AND kind IS NOT NULL THEN 760 WHEN kind IS NULL OR kind = 'conflict' THEN 0 ELSE 840 END AS score_mille, topics, industries
    FROM (SELECT *, {_BY_HAND} AS kind, {_tags(_TOPIC_WORDS)} AS topics, {_tags(_INDUSTRY_WORDS)} AS industries FROM content)""",
)
def taxonomy_loaded(spark, d):
    rules, tags = [r for role, text in PACKS.items() for r in load_role_pack(text, role)], load_tags(TAGS)
    rows, content = X2.with_hits(_sourced(spark, d), F.col("title"), F.col("summary"), rules, tags)
    rows = rows.transform(X2.classified, F.col("s_role"), content, rules, tags)
    return rows.select("id", "t.primary_type", "t.reason", F.round(F.col("t.score") * 1000).cast("int").alias("score_mille"), F.array_join("t.topics", ",").alias("topics"), F.array_join("t.industries", ",").alias("industries"))
