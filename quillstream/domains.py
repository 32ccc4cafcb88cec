"""Closed value domains in declaration order; the order breaks ties and orders tags."""

# Fixed values.
CATEGORIES = ["model_technology", "agent_product", "enterprise_case", "award_case", "solicitation", "policy_industry", "irrelevant", "unclassified"]
PRIMARY_TYPES = ["unclassified", "product_update", "policy_standard", "application_opportunity", "award_result", "report_release", "case_analysis", "industry_signal"]
TOPICS = ["model", "agent", "agent_platform", "api", "open_source", "industry_application", "policy", "standard", "award", "case", "safety_governance", "data_and_compute"]
INDUSTRIES = ["government", "finance", "manufacturing", "energy", "transport", "healthcare", "education", "telecom", "internet", "retail", "general"]
VERIFICATION = ["official_confirmed", "official_linked", "multi_source_confirmed", "media_only", "rumor_or_prediction"]
REVIEW = ["not_required", "pending", "approved", "rejected"]
TIERS = ["government", "official_company", "association", "authoritative_media", "fallback"]
ROLES = ["official_product", "official_policy", "official_industry", "opportunity_and_award_hub", "official_case_hub", "report_hub", "media_discovery", "fallback"]
SCOPES = ["leadership", "formal_export", "all", "non_formal", "disabled", "fallback", "industry_leads"]
KINDS = ["formal", "test", "fallback"]
ORIGINS = ["preset", "user_added", "imported"]
AUDIENCES = ["leadership", "all"]
LIFECYCLES = ["candidate", "active", "paused"]
POLICIES = ["auto_publish", "review_on_low_confidence", "always_review", "never_publish"]
TRIGGERS = ["legacy_manual", "manual_web", "manual_cli", "scheduled"]
IMPLEMENTATION = ["ready", "needs_custom_collector", "blocked_by_javascript", "research_needed"]
COMPLETENESS = ["not_case", "case_lead", "partial_case", "full_case"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
