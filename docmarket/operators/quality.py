"""Rule-table scores of a document: archetype, parser confidence, quality, ATS compliance.

The rules are data: conditions in SQL over the signal columns, with points. A rule
table is evaluated inside the row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from docmarket.functions import text as T
from docmarket.operators.structure import lines_of

# --- fixed values -------------------------------------------------------------
EVIDENCE_VERBS = (
    "achieved", "analyzed", "automated", "built", "created", "delivered", "deployed", "designed", "developed", "diagnosed", "drove", "implemented",
    "improved", "increased", "launched", "led", "managed", "migrated", "optimized", "reduced", "resolved", "shipped", "streamlined",
)
IMPACT = r"(?iU)\b(?:\d+%|\d+\s*(?:x|k|m|hours?|days?|weeks?|months?|users?|customers?|tickets?|alerts?|reports?|dashboards?|apis?|models?|projects?))\b"
NUMBERS = r"(?U)(?:\b\d+%|\b\d+[kKmM]?\b)"
AT_DIGIT = r"(?U)(?=\d)"  # both start with a digit: one look passes over all other places

# (label, points, condition, reason). First listed label wins a tie.
ARCHETYPE_LABELS = (
    "europass_cv", "academic_cv", "government_resume", "teaching_cv", "executive_cv", "long_form_cv", "hybrid_resume", "career_change_resume",
    "modern_two_column_project_first", "creative_portfolio_resume", "modern_two_column", "project_first_entry_level", "functional_resume",
    "skills_first", "technical_portfolio_resume", "one_page_concise", "certification_first_resume", "research_transition_resume",
    "reverse_chronological", "general_resume",
)
ARCHETYPE_RULES: tuple[tuple[str, float, str, str], ...] = (
    ("europass_cv", 95, "says_europass", "europass wording"),
    ("academic_cv", 42, "has_research OR has_publications OR has_teaching OR has_awards", "academic sections"),
    ("academic_cv", 22, "has_research OR has_publications", "research sections"),
    ("academic_cv", 18, "academic_marker_count >= 2", "academic wording"),
    ("academic_cv", 16, "says_publications AND page_count >= 2", "publications over several pages"),
    ("government_resume", 72, "says_government", "government wording"),
    ("teaching_cv", 46, "(has_teaching OR teaching_marker_count >= 2) AND has_education", "teaching with education"),
    ("teaching_cv", 22, "says_teaching", "teaching wording"),
    ("executive_cv", 18, "experience_years >= 8", "seniority"),
    ("executive_cv", 36, "executive_marker_count >= 2", "leadership wording"),
    ("long_form_cv", 52, "page_count >= 3 AND word_count >= 900 AND NOT (has_research OR has_publications)", "long document without research"),
    ("hybrid_resume", 38, "experience_years >= 4 AND has_projects AND has_skills AND summary_section_word_count >= 18", "summary, skills, projects and experience"),
    ("hybrid_resume", 16, "experience_section_word_count >= 90 AND skills_section_word_count >= 20 AND has_projects", "balanced evidence"),
    ("career_change_resume", 38, "objective_marker_count >= 1 AND has_projects AND experience_years < 4", "objective with projects"),
    ("modern_two_column", 34, "multi_column_detected", "several columns"),
    ("modern_two_column_project_first", 44, "multi_column_detected AND has_projects AND experience_years < 1.5", "projects in columns"),
    ("creative_portfolio_resume", 46, "multi_column_detected AND contact_link_count >= 1 AND (creative_marker_count >= 2 OR says_design_site)", "portfolio links in columns"),
    ("project_first_entry_level", 44, "has_projects AND experience_years < 1.5 AND project_focus_share >= 0.34", "projects before work history"),
    ("skills_first", 24, "has_skills AND skills_focus_share >= 0.34", "skills dominate"),
    ("functional_resume", 42, "has_skills AND skills_focus_share >= 0.34 AND (experience_section_word_count < 45 OR chronology_signal_count = 0)", "skills without chronology"),
    ("technical_portfolio_resume", 42, "has_projects AND contact_link_count >= 1 AND technical_portfolio_marker_count >= 2", "projects with technical links"),
    ("one_page_concise", 42, "word_count <= 420 AND page_count <= 1 AND section_count >= 4", "one page with clear sections"),
    ("certification_first_resume", 26, "certifications_section_word_count >= 16 OR certification_marker_count >= 2", "certifications stressed"),
    ("certification_first_resume", 14, "(certifications_section_word_count >= 16 OR certification_marker_count >= 2) AND experience_years <= 2", "training before work"),
    ("research_transition_resume", 44, "(has_research OR has_publications) AND experience_years < 3", "research with little experience"),
    ("reverse_chronological", 34, "has_experience AND chronology_signal_count >= 1", "dated experience"),
    ("reverse_chronological", 12, "has_experience AND experience_section_word_count >= skills_section_word_count", "experience outweighs skills"),
    ("hybrid_resume", 8, "section_balance_score >= 72 AND summary_section_word_count >= 12 AND has_experience", "even sections"),
    ("skills_first", 10, "skills_focus_share >= 0.5 AND NOT has_projects", "skills only"),
)
TEXT_FLAGS = {
    "says_europass": ("europass", "personal information", "mother tongue"),
    "says_publications": ("publications",),
    "says_government": ("clearance", "federal", "government", "citizenship"),
    "says_teaching": ("lecturer", "curriculum", "lesson planning"),
    "says_design_site": ("behance", "dribbble"),
}
RECOVERED = (
    "multi_column_detected AND date_range_count >= 3 AND bullet_like_line_count >= 4 AND chronology_signal_count >= 3"
    " AND section_leakage_count = 0 AND suspicious_token_count < 2 AND suspicious_url_count = 0"
)
CLEAN_LINKS = "suspicious_url_count = 0 AND suspicious_token_count = 0"

# Groups of (condition, points): the first true condition of a group counts.
QUALITY_START, QUALITY_FLOOR = 18.0, 18.0
QUALITY_RULES: tuple[tuple[tuple[str, float], ...], ...] = (
    (
        ("word_count BETWEEN 250 AND CASE WHEN archetype = 'academic_cv' THEN 1400 ELSE 900 END", 12),
        ("word_count BETWEEN 180 AND CASE WHEN archetype = 'academic_cv' THEN 1800 ELSE 1100 END", 7),
        ("word_count < 160", -4),
        ("true", -3),
    ),
    (("section_count >= 4", 10),),
    (("summary_section_word_count BETWEEN 12 AND 70", 5), ("has_summary", 2)),
    (("summary_line_count >= 4", -2),),
    (("skills_count >= 6", 4),),
    (("experience_action_line_count >= 4", 10), ("experience_action_line_count >= 2", 6)),
    (("experience_quantified_line_count >= 3", 10), ("experience_quantified_line_count >= 1", 5)),
    (("projects_action_line_count >= 2", 5),),
    (("projects_quantified_line_count >= 1", 4),),
    (("has_experience AND has_projects", 4),),
    (("has_experience AND has_skills", 4),),
    (("action_verb_variety_count >= 5", 5), ("action_verb_variety_count >= 3", 3)),
    (("avg_bullet_word_count BETWEEN 9 AND 24", 5), ("avg_bullet_word_count > 30", -3)),
    (("evidence_bullet_count >= 4", 4),),
    (("section_balance_score >= 75", 8), ("section_balance_score >= 60", 4)),
    (("dominant_section_share > 0.62", -4),),
    (("skills_focus_share > 0.42 AND experience_section_word_count < 60", -8),),
    (("archetype IN ('project_first_entry_level', 'modern_two_column_project_first') AND has_projects", 6),),
    (("archetype = 'academic_cv' AND section_count >= 5", 6),),
    (("archetype = 'europass_cv'", 2),),
    (("archetype = 'technical_portfolio_resume' AND portfolio_link_count >= 1", 5),),
    (("archetype = 'creative_portfolio_resume' AND portfolio_link_count >= 1", 6),),
    (("contact_link_count >= 2", 2),),
    ((CLEAN_LINKS, 3),),
    (("chronology_signal_count >= 2", 2),),
    (("objective_marker_count > 0", -4),),
    (("first_person_pronoun_count >= 2", -3),),
)
QUALITY_COUNTS = (("verb_hits", 1.5, 8), ("number_hits", 1.4, 10), ("impact_hits", 1.2, 8))
# (column, points each, cap)
QUALITY_PENALTIES = (
    ("merged_header_count", 2, 4), ("inline_header_count", 0.75, 2), ("section_leakage_count", 4, 8), ("suspicious_token_count", 1, 4),
    ("suspicious_url_count", 2, 4), ("long_evidence_line_count", 1.5, 8), ("dense_paragraph_line_count", 1.5, 6), ("weak_bullet_count", 1.2, 6),
    ("short_bullet_count", 1.0, 4),
)
QUALITY_FLAGS = (
    ("inferred_skills_section", 2), ("has_experience AND experience_action_line_count = 0", 5),
    ("has_experience AND experience_quantified_line_count = 0", 5), ("has_experience AND date_range_count = 0", 3),
)
QUALITY_TOP = 96.0
QUALITY_CAPS = (
    ("multi_column_detected AND explicit_header_count < 4", 72), ("section_leakage_count >= 2", 64),
    ("experience_section_word_count > 0 AND experience_action_line_count = 0 AND experience_quantified_line_count = 0", 58),
    ("suspicious_token_count >= 2 OR suspicious_url_count >= 1", 68), ("dense_paragraph_line_count >= 3", 66),
    ("skills_focus_share > 0.42 AND experience_section_word_count < 70", 62),
)

ATS_START, ATS_FLOOR = 18.0, 14.0
ATS_RULES: tuple[tuple[tuple[str, float], ...], ...] = (
    (("has_experience", 7),), (("has_education", 7),), (("has_skills", 7),),
    (("has_experience AND has_education AND has_skills", 4),),
    (("has_email", 6),), (("has_phone", 4),), (("has_email AND has_phone", 2),),
    (("content_type LIKE '%wordprocessingml%'", 4), ("content_type LIKE '%pdf%'", 2)),
    (("word_count BETWEEN 220 AND 1050", 5),),
    (("explicit_header_count >= 5", 14), ("explicit_header_count >= 3", 10), ("explicit_header_count >= 1", 4)),
    (("NOT says_table", 3),),
    (("has_skills AND NOT inferred_skills_section", 5),),
    (("date_range_count >= 1", 8),), (("date_range_count >= 3", 3),),
    (("contact_link_count >= 1", 2),), (("bullet_like_line_count >= 2", 3),), (("chronology_signal_count >= 2", 4),), (("section_balance_score >= 70", 2),),
    ((f"multi_column_detected AND {RECOVERED}", -6), ("multi_column_detected", -12)),
    (("multi_column_detected AND explicit_header_count >= 4", 2),),
    (("archetype = 'europass_cv'", 4),), (("archetype IN ('reverse_chronological', 'one_page_concise')", 3),),
    ((CLEAN_LINKS, 3),),
)
ATS_PENALTIES = (
    ("section_leakage_count", 5, 12), ("suspicious_token_count", 2, 10), ("suspicious_url_count", 4, 12), ("dense_paragraph_line_count", 1.5, 8),
    ("objective_marker_count", 2, 5), ("long_evidence_line_count", 1.5, 6),
)
# Penalties that are lighter when a column layout was recovered well: (column, each, cap, each if recovered, cap if recovered).
ATS_LAYOUT_PENALTIES = (("merged_header_count", 5, 16, 2, 8), ("inline_header_count", 2.5, 12, 1, 6))
ATS_FLAGS = (
    (f"inferred_skills_section AND {RECOVERED} AND skills_count >= 5", 4), (f"inferred_skills_section AND NOT ({RECOVERED} AND skills_count >= 5)", 10),
    (f"has_experience AND explicit_header_count < 2 AND NOT ({RECOVERED})", 4), ("has_experience AND date_range_count = 0", 8),
    ("portfolio_link_count = 0 AND archetype IN ('creative_portfolio_resume', 'technical_portfolio_resume')", 4),
    ("has_experience AND bullet_like_line_count = 0", 6), ("has_experience AND chronology_signal_count = 0", 4),
)
ATS_TOP = 95.0
ATS_CAPS = (
    ("multi_column_detected AND explicit_header_count < 4", 70), ("merged_header_count >= 1 OR section_leakage_count >= 1", 78), ("inferred_skills_section", 74),
    ("suspicious_token_count >= 2 OR suspicious_url_count >= 1", 68),
    ("CAST(has_experience AS INT) + CAST(has_education AS INT) + CAST(has_skills AS INT) <= 1", 72), ("NOT has_email AND NOT has_phone", 76),
    ("has_experience AND date_range_count = 0 AND bullet_like_line_count = 0", 58),
)
CONFIDENCE_PENALTIES = (
    ("merged_header_count", 5, 16), ("inline_header_count", 2, 10), ("section_leakage_count", 7, 16), ("suspicious_token_count", 4, 18), ("suspicious_url_count", 5, 12),
)
CONFIDENCE_FLAGS = (("inferred_skills_section", 8), ("multi_column_detected", 7))
RISK_REASONS = (
    ("multi_column_detected", "several columns"), ("inferred_skills_section", "skills section recovered"), ("merged_header_count >= 1", "merged headers"),
    ("inline_header_count >= 1", "inline headers"), ("section_leakage_count >= 1", "section leakage"),
    ("suspicious_token_count >= 2 OR suspicious_url_count >= 1", "export noise"),
)
# ------------------------------------------------------------------------------


def _num(x: float) -> str:
    return f"{float(x)!r}D"


def _first_true(group: Sequence[tuple[str, float]]) -> Column:
    return F.expr("CASE " + " ".join(f"WHEN {cond} THEN {_num(points)}" for cond, points in group) + " ELSE 0.0D END")


def _total(parts: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for part in parts:
        out = out + part
    return out


def _capped(column: str, each: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.col(column) * F.lit(float(each)))


def _flag(cond: str, points: float) -> Column:
    return F.expr(f"CASE WHEN {cond} THEN {_num(points)} ELSE 0.0D END")


def _cap(top: float, caps: Sequence[tuple[str, float]]) -> Column:
    return F.least(F.lit(top), *[F.expr(f"CASE WHEN {cond} THEN {_num(limit)} ELSE {_num(top)} END") for cond, limit in caps])


def text_flags(text: Column) -> dict[str, Column]:
    """Plain wording flags of the archetype and ATS rules."""
    low = F.lower(text)
    flags = {name: T.contains_any(low, phrases) for name, phrases in TEXT_FLAGS.items()}
    flags["says_table"] = T.contains_any(low, ("table", "textbox"))
    return flags


def text_evidence(text: Column, verbs: Sequence[str] = EVIDENCE_VERBS) -> dict[str, Column]:
    """Verb, number and impact counts; a verb counts once, also inside a longer word."""
    low = F.lower(text)
    return {
        "verb_hits": _total([F.contains(low, F.lit(v)).cast("double") for v in verbs]),
        "number_hits": F.regexp_count(text, F.lit(AT_DIGIT + NUMBERS)),
        "impact_hits": F.regexp_count(text, F.lit(AT_DIGIT + IMPACT)),
    }


def repetition_penalty(text: Column, verbs: Sequence[str] = EVIDENCE_VERBS, key_len: int = 80, min_len: int = 35, min_lines: int = 6) -> Column:
    """Points for repeated lines and for one verb opening most lines; inside the row."""

    def score(lines: Column) -> Column:
        keys = F.filter(F.transform(lines, lambda x: F.substring(x, 1, key_len)), lambda k: F.length(k) >= min_len)
        repeated = T.let(keys, lambda k: F.size(k) - F.size(F.array_distinct(k)))
        first = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "^([a-z]*)", 1)), lambda w: w.isin(*verbs))

        def leading(ws: Column) -> Column:
            most = F.array_max(F.transform(T.lit_array(verbs), lambda v: F.size(F.filter(ws, lambda w: w == v))))
            return F.when((F.size(ws) >= 4) & (most / F.greatest(F.size(ws), F.lit(1)) >= 0.55), 2.0).otherwise(0.0)

        penalty = F.least(F.lit(4.0), repeated * F.lit(1.5)) + T.let(first, leading)
        return F.when(F.size(lines) < min_lines, 0.0).otherwise(F.least(F.lit(6.0), penalty))

    lines = F.transform(lines_of(text), lambda x: F.regexp_replace(F.lower(T.normalize_ws(x)), r"^[\-*•\s]+", ""))
    return T.let(lines, score)


def classify_archetype(rules=ARCHETYPE_RULES, labels: Sequence[str] = ARCHETYPE_LABELS) -> Column:
    """struct(archetype, confidence, reasons) from the signal columns."""
    fired = F.array_compact(
        F.array(*[F.expr(f"CASE WHEN {cond} THEN named_struct('label', '{label}', 'points', {_num(points)}, 'reason', '{reason}') END") for label, points, cond, reason in rules])
    )

    def decide(hits: Column) -> Column:
        def total(label: Column, i: Column) -> Column:
            points = F.aggregate(F.filter(hits, lambda h: h["label"] == label), F.lit(0.0), lambda a, h: a + h["points"])
            return F.struct(points.alias("points"), (-i).alias("order"), label.alias("label"))

        def best(ranked: Column) -> Column:
            top, second = F.get(ranked, 0), F.get(ranked, 1)
            confidence = F.least(F.lit(0.93), F.greatest(F.lit(0.62), F.lit(0.6) + top["points"] / 160 + F.least(top["points"] - second["points"], F.lit(24.0)) / 120))
            reasons = F.slice(F.array_distinct(F.transform(F.filter(hits, lambda h: h["label"] == top["label"]), lambda h: h["reason"])), 1, 3)
            weak = F.when(
                F.col("has_experience"), F.struct(F.lit("reverse_chronological").alias("archetype"), F.lit(0.64).alias("confidence"), F.array(F.lit("some timeline")).alias("reasons"))
            ).otherwise(F.struct(F.lit("general_resume").alias("archetype"), F.lit(0.58).alias("confidence"), F.array(F.lit("general structure")).alias("reasons")))
            strong = F.struct(top["label"].alias("archetype"), F.round(confidence, 2).alias("confidence"), reasons.alias("reasons"))
            return F.when(top["points"] < 26, weak).otherwise(strong)

        return T.let(F.sort_array(F.transform(T.lit_array(labels), total), asc=False), best)

    return T.let(fired, decide)


def parser_confidence() -> Column:
    """struct(score, label, reasons): how far the parse can be trusted."""
    lost = _total([_capped(*p) for p in CONFIDENCE_PENALTIES] + [_flag(*f) for f in CONFIDENCE_FLAGS])
    score = F.lit(92.0) - lost + _flag(RECOVERED, 12) + _flag("section_count >= 4", 4)
    bounded = F.round(F.greatest(F.lit(18.0), F.least(F.lit(98.0), score)), 2)
    reasons = F.array_compact(F.array(*[F.expr(f"CASE WHEN {cond} THEN '{reason}' END") for cond, reason in RISK_REASONS]))
    label = F.when(bounded >= 78, "high").when(bounded >= 58, "medium").otherwise("low")
    return F.struct(bounded.alias("score"), label.alias("label"), F.slice(reasons, 1, 6).alias("reasons"))


def document_quality() -> Column:
    """Quality score from signal columns, text evidence and ``repetition``."""
    gained = _total([F.lit(QUALITY_START)] + [_capped(*c) for c in QUALITY_COUNTS] + [_first_true(g) for g in QUALITY_RULES]) - F.col("repetition")
    lost = _total([_capped(*p) for p in QUALITY_PENALTIES] + [_flag(*f) for f in QUALITY_FLAGS])
    lost = F.when(F.expr("multi_column_detected AND explicit_header_count >= 4"), F.greatest(F.lit(0.0), lost - 2)).otherwise(lost)
    return F.greatest(F.lit(QUALITY_FLOOR), F.least(gained - lost, _cap(QUALITY_TOP, QUALITY_CAPS)))


def ats_compliance() -> Column:
    """Layout and parseability score."""
    gained = _total([F.lit(ATS_START)] + [_first_true(g) for g in ATS_RULES])
    layout = [F.when(F.expr(RECOVERED), _capped(c, e2, k2)).otherwise(_capped(c, e1, k1)) for c, e1, k1, e2, k2 in ATS_LAYOUT_PENALTIES]
    lost = _total([_capped(*p) for p in ATS_PENALTIES] + [_flag(*f) for f in ATS_FLAGS] + layout)
    return F.greatest(F.lit(ATS_FLOOR), F.least(gained - lost, _cap(ATS_TOP, ATS_CAPS)))
