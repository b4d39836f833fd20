"""Report tables: recommendations, component feedback, rule-based summary. Message texts are our own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.functions import text as T
from docmarket.operators.ranking import top_per_group

# --- fixed values: thresholds ---------------------------------------------------
MAX_ITEMS, GAP_ITEMS, LEAD_ITEMS = 6, 2, 3
NOISE = "suspicious_token_count >= 3 OR merged_header_count >= 2 OR suspicious_url_count >= 1 OR section_leakage_count >= 1"
RECOVERABLE = "inferred_skills_section AND (section_count < 4 OR skills_section_word_count < 8)"
# (condition, title, impact) in order of precedence
RULES: tuple[tuple[str, str, str], ...] = (
    ("archetype IN ('modern_two_column', 'modern_two_column_project_first')", "Keep a one-column copy", "Medium"),
    ("archetype IN ('project_first_entry_level', 'modern_two_column_project_first')", "Write projects as evidence", "High"),
    ("archetype = 'skills_first'", "Add dates below the skills", "Medium"),
    ("archetype = 'academic_cv'", "Shorten academic detail", "Medium"),
    ("archetype = 'europass_cv'", "Tailor the Europass form", "Medium"),
    ("archetype = 'functional_resume'", "Add dated entries per skill area", "High"),
    ("archetype = 'executive_cv'", "Lead with scope and results", "High"),
    ("archetype = 'creative_portfolio_resume'", "Back links with plain text", "Medium"),
    ("archetype = 'technical_portfolio_resume'", "Turn repositories into bullets", "High"),
    ("archetype = 'one_page_concise'", "Make every line count", "Medium"),
    ("archetype = 'certification_first_resume'", "Prove certificates in practice", "High"),
    ("archetype = 'research_transition_resume'", "Put research in industry terms", "High"),
    ("archetype = 'teaching_cv'", "Lead with classroom results", "High"),
    ("archetype = 'government_resume'", "Keep a short version too", "Medium"),
    ("archetype = 'long_form_cv'", "Trim low-signal detail", "Medium"),
    ("archetype = 'career_change_resume'", "Use the new role's words", "High"),
    (f"({NOISE}) OR ({RECOVERABLE})", "Export in one clean column", "High"),
    (f"ats_compliance < 70 AND (({NOISE}) OR ({RECOVERABLE}))", "Make parsing easier", "High"),
    (f"section_leakage_count > 0 OR ({RECOVERABLE})", "Separate the sections", "High"),
    ("suspicious_url_count > 0", "Repair broken links", "Medium"),
    ("date_range_count = 0 AND has_experience", "Add month and year to each role", "High"),
    ("quantified_line_count < 2", "Put numbers in two bullets", "High"),
    ("contact_link_count = 0", "Add profile links", "Medium"),
    ("resume_quality < 70", "Quantify project results", "High"),
    ("experience_match < 60", "Show outcomes of experience", "Medium"),
    ("true", "Rewrite bullets as action and result", "High"),
    ("true", "Match the role headline", "Medium"),
    ("has_role_model", "Group skills by role family", "Medium"),
)
FEEDBACK: tuple[tuple[str, str, str], ...] = (
    ("skill_match", "n_matched > 0", "matched terms are counted with their proof"),
    ("skill_match", "n_missing > 0", "tool gaps remain"),
    ("skill_match", "n_matched > 0 AND n_missing = 0", "no strong missing cluster"),
    ("semantic_match", "semantic_match < 65", "use the target phrase more"),
    ("semantic_match", "semantic_match >= 65", "language fits the role"),
    ("experience_match", "experience_years <= 0", "no dated experience"),
    ("experience_match", "experience_years > 0 AND experience_years < 1.25", "early career"),
    ("experience_match", "experience_years >= 1.25 AND experience_years < 3", "some years"),
    ("experience_match", "experience_years >= 3", "solid years"),
    ("experience_match", "archetype IN ('project_first_entry_level', 'modern_two_column_project_first')", "projects must read as work"),
    ("experience_match", "archetype IN ('skills_first', 'functional_resume')", "dates are missing"),
    ("experience_match", "archetype = 'research_transition_resume'", "translate research"),
    ("experience_match", "market_source = 'role-baseline' AND baseline_confidence <> 'high'", "score is conservative"),
    ("market_demand", "market_source = 'blended-market'", "sample was blended"),
    ("market_demand", "market_source = 'role-baseline' AND baseline_confidence = 'low'", "weak baseline"),
    ("market_demand", "market_source = 'role-baseline' AND baseline_confidence <> 'low'", "baseline only"),
    ("market_demand", "market_source NOT IN ('blended-market', 'role-baseline')", "sampled listings"),
    ("resume_quality", "section_leakage_count > 0 OR (inferred_skills_section AND section_count < 4)", "separate the blocks"),
    ("resume_quality", "quantified_line_count < 2", "too few numbers"),
    ("resume_quality", "bullet_like_line_count < 2 AND has_experience", "reads like a paragraph"),
    ("resume_quality", "resume_quality < 70", "add outcomes"),
    ("resume_quality", "archetype = 'executive_cv'", "show scope"),
    ("ats_compliance", "multi_column_detected OR merged_header_count > 0 OR section_leakage_count > 0", "layout risk"),
    ("ats_compliance", "merged_header_count >= 2 OR (inferred_skills_section AND section_count < 4)", "headings merged"),
    ("ats_compliance", "suspicious_url_count > 0", "links broken"),
    ("ats_compliance", "multi_column_detected", "keep a plain export"),
    ("ats_compliance", "date_range_count = 0 AND has_experience", "chronology weak"),
    ("ats_compliance", "contact_link_count = 0", "no profile link"),
    ("ats_compliance", "archetype IN ('creative_portfolio_resume', 'technical_portfolio_resume')", "portfolio needs text"),
)
# --------------------------------------------------------------------------------


def recommendations(runs: DataFrame, key: str, gaps: DataFrame, modelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """At most six actions per run: gap-driven first (up to three), then the rules in order; one per title.

    gaps: key, term, share, signal_source, position (weak proofs before missing terms);
    modelled: key, term, pos (recommended terms the document lacks).
    """
    src, term = F.col("signal_source"), F.col("term")
    proof = lambda t: F.concat(F.lit("Build stronger proof for "), t)
    title = F.when(src.isin("weak-resume-proof", "live-support"), proof(term)).when(src == "role-family", F.concat(F.lit("Consider adding or learning "), term)).otherwise(F.concat(F.lit("Add or learn "), term))
    impact = F.when(src == "weak-resume-proof", F.when(F.col("share") >= 8.0, "High").otherwise("Medium")).when(src.isin("live-support", "role-family"), "Medium").otherwise("High")
    lead = top_per_group(gaps, [key], [F.asc("position"), F.asc("term")], GAP_ITEMS, "no").select(key, "no", title.alias("title"), impact.alias("impact"), term.alias("term"))
    # Modelled gaps fill up to three lead items, unless an item already names the term.
    lead_text = lead.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("title")), "|").alias("titles"))
    spare = modelled.join(lead_text, [key], "left").filter(F.col("titles").isNull() | ~F.contains(F.lower("titles"), F.lower("term")))
    spare = top_per_group(spare, [key], [F.asc("pos"), F.asc("term")], LEAD_ITEMS, "r").filter(F.col("r") <= F.lit(LEAD_ITEMS) - F.coalesce("n", F.lit(0)))
    spare = spare.select(key, (F.col("r") + 10).alias("no"), proof(F.col("term")).alias("title"), F.lit("Medium").alias("impact"))
    fired = F.array_compact(
        F.array(*[F.when(F.expr(cond), F.struct(F.lit(100 + i).alias("no"), F.lit(t).alias("title"), F.lit(im).alias("impact"))) for i, (cond, t, im) in enumerate(rules)])
    )
    ruled = T.explode_once(runs, [key], fired, "x").select(key, "x.no", "x.title", "x.impact")
    every = lead.drop("term").unionByName(spare).unionByName(ruled)
    once = every.groupBy(key, "title").agg(F.min(F.struct("no", "impact")).alias("m")).select(key, "title", "m.no", "m.impact")
    return top_per_group(once, [key], [F.asc("no")], MAX_ITEMS, "position").drop("no")


def component_feedback(rules: Sequence[tuple[str, str, str]] = FEEDBACK) -> dict[str, Column]:
    """One array of messages per component."""
    out: dict[str, list[Column]] = {}
    for component, cond, message in rules:
        out.setdefault(component, []).append(F.when(F.expr(cond), F.lit(message)))
    return {name: F.array_compact(F.array(*parts)) for name, parts in out.items()}


def rule_summary() -> dict[str, Column]:
    """Strengths, weaknesses and next steps from counts and the first missing terms (array ``missing_terms`` of term and share)."""
    c = F.col
    strengths = F.array_compact(
        F.array(
            F.when(c("n_matched") >= 5, "strong market alignment"),
            F.when(c("experience_years") >= 2, "credible experience").when(c("experience_years") >= 0.25, "early-career evidence"),
            F.when(c("has_projects"), "practical projects"),
        )
    )
    gaps = F.transform(F.slice("missing_terms", 1, 3), lambda x: F.concat(x["term"], F.lit(" carries "), x["share"], F.lit("% of demand")))
    weak = F.when(F.size(gaps) > 0, gaps).otherwise(F.array(F.lit("add role-specific evidence")))
    return {
        "strengths": F.when(F.size(strengths) > 0, strengths).otherwise(F.array(F.lit("usable base"))),
        "weaknesses": F.when(c("used_role_baseline"), F.concat(F.array(F.lit("baseline market")), weak)).otherwise(weak),
        "next_steps": F.array(F.lit("tailor summary and bullets"), F.lit("add measurable impact"), F.lit("add demanded tools you know")),
    }
