"""Catalogues and taxonomy packs: what is loaded, and every kind of fault."""

import pytest
import yaml

from quillstream import domains as D
from quillstream.plans.pack_queries import PACKS, TAGS
from quillstream.sources.catalogs import catalog_table, load_catalog, load_role_pack, load_tags
from quillstream.sources.rule_packs import PackError

ENTRY = {
    "slug": "city-news", "name": " City news ", "url": "HTTPS://News.example/list/?utm_source=x", "lifecycle_state": "active", "source_role": "official_policy", "source_tier": "government", "audience": "all",
    "crawl_mode": "rss", "review_policy": "auto_publish", "allowed_primary_types": ["policy_standard"], "homepage_visible": True, "export_visible": False, "lookback_days": 45, "max_items_per_run": 20,
    "implementation_status": "ready", "implementation_reason": "feed", "verified_at": "2026-01-02T03:00:00+08:00", "activation_evidence": "seen", "notes": "n", "collector_name": "rss",
    "collector_config": {"b": [1], "a": "x"}, "include_terms": ["one", "two"], "exclude_terms": [], "minimum_quality_score": 48, "allow_external_links": False,
}
LEADS = ENTRY | {"slug": "leads", "url": "https://leads.example/", "lifecycle_state": "candidate", "source_role": "media_discovery", "homepage_visible": False, "review_policy": "always_review", "implementation_status": "research_needed", "verified_at": None, "activation_evidence": None}


def text(*entries, version=1, **more):
    return yaml.safe_dump({"version": version, "sources": list(entries)} | more)


def test_a_catalogue_becomes_a_table(spark):
    entries = load_catalog(text(ENTRY, LEADS))
    rows = catalog_table(spark, entries).orderBy("position").collect()
    first = rows[0]
    assert (first.slug, first.start_url, first.name, first.position, first.minimum_quality_score, first.include_terms) == ("city-news", "https://news.example/list", "City news", 0, 48.0, ["one", "two"])
    assert first.collector_config == '{"a": "x", "b": [1]}' and first.verified_at.isoformat() in ("2026-01-01T19:00:00", "2026-01-02T03:00:00")
    assert (rows[1].lifecycle, rows[1].verified_at, rows[1].activation_evidence) == ("candidate", None, None)
    assert load_catalog(text()) == [] and catalog_table(spark, []).count() == 0


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({"slug": "City"}, "slug"), ({"slug": "a" * 101}, "slug"), ({"slug": None}, "slug"), ({"url": "ftp://x.example/"}, "url"), ({"name": "  "}, "name"), ({"lifecycle_state": "gone"}, "lifecycle_state"),
        ({"audience": 3}, "audience"), ({"allowed_primary_types": ["x"]}, "allowed_primary_types"), ({"include_terms": ["a", " a"]}, "given twice"), ({"include_terms": "a"}, "list of texts"), ({"homepage_visible": 1}, "homepage_visible"),
        ({"lookback_days": 3651}, "lookback_days"), ({"lookback_days": True}, "lookback_days"), ({"max_items_per_run": 0}, "max_items_per_run"), ({"verified_at": "2026-01-02T03:00:00"}, "verified_at"), ({"verified_at": "soon"}, "verified_at"),
        ({"minimum_quality_score": 101}, "minimum_quality_score"), ({"minimum_quality_score": True}, "minimum_quality_score"), ({"minimum_quality_score": float("nan")}, "minimum_quality_score"), ({"collector_config": {1: 2}}, "collector_config"),
        ({"activation_evidence": None}, "evidenced"), ({"implementation_status": "research_needed"}, "without being ready"), ({"source_role": "media_discovery"}, "hidden"), ({"other": 1}, "unknown key other"),
    ],
)
def test_faults_of_entries(change, fault):
    with pytest.raises(PackError, match=fault):
        load_catalog(text(ENTRY | change))


def test_faults_of_whole_catalogues():
    with pytest.raises(PackError) as e:
        load_catalog(text(ENTRY, ENTRY | {"slug": "again"}, LEADS | {"slug": "again"}, {k: v for k, v in LEADS.items() if k != "notes"}, version=2))
    assert len(str(e.value).split("\n")) == 5
    for broken, fault in (("sources: [", "not readable"), ("[]", "not a mapping"), ("version: 1\nversion: 1\nsources: []", "given twice"), ("version: 1\nsources: {}", "not a list"), ("version: 1\nsources: [3]", "not a mapping")):
        with pytest.raises(PackError, match=fault):
            load_catalog(broken)
    with pytest.raises(PackError, match="retired: city-news"):
        load_catalog(text(ENTRY), ("https://news.example/list/",))


def test_role_packs_are_ordered_and_checked():
    low, high = (r for r in reversed(load_role_pack(PACKS["official_policy"], "official_policy")))
    assert (high.id, high.subjects, high.topics, low.priority) == ("policy.high", ("that", "this"), ("policy", "agent"), 40)
    assert load_role_pack("whatever", "fallback") == []
    good = PACKS["official_policy"]
    for part, broken, fault in (
        ("version: v2", "version: v1", "version"), ("role: official_policy", "role: report_hub", "not official_policy"), ("policy.low", "policy.high", "rule given twice"), ("priority: 40", "priority: high", "integer"), ("priority: 40, ", "", "no priority"),
        ("report_release", "reports", "primary_type"), ("[tion, from]", "[tion, TION]", "given twice"), ("[tion, from]", "[tion, '']", "list of texts"), ("[policy, agent]", "[policy, agents]", "no topic"), ("id: policy.low", "id: 3", "needs a text"),
    ):
        assert part in good
        with pytest.raises(PackError, match=fault):
            load_role_pack(good.replace(part, broken), "official_policy")


def test_tags_name_every_topic_and_industry():
    tags = load_tags(TAGS)
    assert list(tags.topics) == D.TOPICS and list(tags.industries) == D.INDUSTRIES[:-1] and tags.topics["model"] == ["that"]
    for part, broken, fault in (("  model: [THAT]\n", "", "no model"), ("  model: [THAT]", "  model: [THAT]\n  general: [x]", "unknown key general"), ("[THAT]", "[TIME, time]", "given twice"), ("[THAT]", "3", "list of texts"), ("version: v2", "version: 2", "version")):
        with pytest.raises(PackError, match=fault):
            load_tags(TAGS.replace(part, broken))


def test_preview_statistics_by_hand(spark):
    """Ratios are over the rows without an error; a source of which none is left has failed."""
    from quillstream.operators.intake import preview_stats

    rows = [
        (1, "a.example", None, "https://a.example/1", 5, True, None, "case_analysis"), (1, "a.example", None, "https://a.example/1", None, False, "low", None), (1, "a.example", "no title", None, 5, True, None, "report_release"),
        (1, "a.example", None, "https://b.example/2", 5, False, "low", "case_analysis"), (2, "a.example", "no title", None, None, None, None, None), (None, None, None, None, None, True, None, "case_analysis"),
    ]
    df = spark.createDataFrame(rows, "source_id long, site_host string, error string, canonical_url string, published_at long, accepted boolean, reason string, primary_type string")
    got = {r.source_id: r for r in preview_stats(df).collect()}
    a, b, none = got[1], got[2], got[None]
    assert (a.status, a.discovered, a.normalized, a.accepted, a.rejected, a.failed, a.duplicates) == ("success", 4, 3, 1, 2, 1, 1)
    assert (a.title_ratio, round(a.date_ratio, 6), a.link_ratio, round(a.external_ratio, 6)) == (1.0, 0.666667, 1.0, 0.333333)
    assert (a.failures, a.rejections, a.primary_types) == ({"no title": 1}, {"low": 2}, {"case_analysis": 2})
    assert (b.status, b.failed, b.title_ratio, b.failures, b.rejections, b.primary_types) == ("failed", 1, 0.0, {"no title": 1}, None, None)
    assert (none.normalized, none.link_ratio, none.primary_types) == (1, 0.0, {"case_analysis": 1})
    assert preview_stats(df.filter("false")).isEmpty()
