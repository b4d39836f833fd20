"""Rule-table scores; order numbers stand in for the signals so that every rule is reached."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.catalog.structure import LINES
from docmarket.functions import text as T
from docmarket.operators import quality as Q
from docmarket.registry import query
from docmarket.sources.tables import table

VERBS = ("the", "and", "for", "ein", "que", "les", "of")
_RANGES = {  # column -> (multiplier, modulus)
    "word_count": (7919, 1900), "section_count": (31, 8), "page_count": (37, 5), "skills_count": (41, 11), "summary_section_word_count": (43, 90), "experience_section_word_count": (47, 140),
    "projects_section_word_count": (53, 80), "skills_section_word_count": (59, 60), "certifications_section_word_count": (61, 24), "explicit_header_count": (67, 8),
    "inline_header_count": (71, 6), "merged_header_count": (73, 5), "section_leakage_count": (79, 4), "suspicious_token_count": (83, 4), "suspicious_url_count": (89, 3),
    "date_range_count": (97, 6), "contact_link_count": (101, 4), "portfolio_link_count": (103, 3), "bullet_like_line_count": (107, 9), "chronology_signal_count": (109, 6),
    "summary_line_count": (113, 7), "experience_action_line_count": (127, 7), "experience_quantified_line_count": (131, 6), "projects_action_line_count": (137, 4),
    "projects_quantified_line_count": (139, 3), "action_verb_variety_count": (149, 8), "evidence_bullet_count": (151, 8), "long_evidence_line_count": (157, 7),
    "dense_paragraph_line_count": (163, 5), "weak_bullet_count": (167, 7), "short_bullet_count": (173, 6), "objective_marker_count": (179, 3), "first_person_pronoun_count": (181, 5),
    "academic_marker_count": (191, 5), "teaching_marker_count": (193, 6), "executive_marker_count": (197, 5), "creative_marker_count": (199, 5),
    "technical_portfolio_marker_count": (211, 5), "certification_marker_count": (223, 6), "verb_hits": (227, 9), "number_hits": (229, 12), "impact_hits": (233, 9),
}
_SHARES = {"dominant_section_share": (239, 100, 100), "skills_focus_share": (241, 100, 100), "project_focus_share": (251, 100, 100), "section_balance_score": (257, 10000, 100),
           "avg_bullet_word_count": (263, 400, 10), "experience_years": (269, 120, 10), "repetition": (271, 13, 2)}
_FLAGS = {
    "has_summary": (277, 2), "has_experience": (281, 4), "has_projects": (283, 2), "has_education": (293, 3), "has_skills": (307, 3), "has_research": (311, 9), "has_publications": (313, 11),
    "has_teaching": (317, 11), "has_awards": (331, 13), "multi_column_detected": (337, 3), "inferred_skills_section": (347, 5), "has_email": (349, 5), "has_phone": (353, 4),
    "says_europass": (359, 23), "says_publications": (367, 5), "says_government": (373, 23), "says_teaching": (379, 17), "says_design_site": (383, 7), "says_table": (389, 6),
}
# "has" flags are mostly true where the modulus is large on purpose only for rare wording
_RARE = {"says_europass", "says_publications", "says_government", "says_teaching", "says_design_site", "says_table", "has_research", "has_publications", "has_teaching", "has_awards", "inferred_skills_section"}
SIGNALS: dict[str, str] = {n: f"(o_orderkey * {m} + 7) % {k}" for n, (m, k) in _RANGES.items()}
SIGNALS |= {n: f"CAST((o_orderkey * {m} + 11) % {k} AS DOUBLE) / {d}" for n, (m, k, d) in _SHARES.items()}
SIGNALS |= {n: f"(o_orderkey * {m} + o_custkey) % {k} {'=' if n in _RARE else '<>'} 0" for n, (m, k) in _FLAGS.items()}
SIGNALS["content_type"] = "CASE o_orderkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/wordprocessingml' ELSE 'text' END"
_LABELS = ", ".join(f"'{x}'" for x in Q.ARCHETYPE_LABELS)
SIGNALS_SQL = "signals AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in SIGNALS.items()) + f", ([{_LABELS}])[CAST(o_custkey % {len(Q.ARCHETYPE_LABELS)} AS BIGINT) + 1] AS archetype FROM orders)"


def signals(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in SIGNALS.items()], f"element_at(array({_LABELS}), CAST(o_custkey % {len(Q.ARCHETYPE_LABELS)} AS INT) + 1) AS archetype")
    return orders


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def groups_sql(rules) -> str:
    return " + ".join("CASE " + " ".join(f"WHEN {c} THEN {_d(p)}" for c, p in g) + " ELSE 0 END" for g in rules)


def capped_sql(items) -> str:
    return " + ".join(f"least({_d(k)}, {c} * {_d(e)})" for c, e, k in items)


def flags_sql(items) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {_d(p)} ELSE 0 END" for c, p in items)


def caps_sql(top, caps) -> str:
    return "least(" + ", ".join([_d(top)] + [f"CASE WHEN {c} THEN {_d(k)} ELSE {_d(top)} END" for c, k in caps]) + ")"


@query(
    "C12_repetition_penalty",
    f"""WITH l AS (SELECT doc_id, list_transform({LINES}, lambda x: regexp_replace(lower({S.ws('x')}), '^[\\-*•\\s]+', '')) AS l FROM documents),
    k AS (SELECT doc_id, l, list_filter(list_transform(l, lambda x: substring(x, 1, 80)), lambda x: length(x) >= 35) AS keys,
      list_filter(list_transform(l, lambda x: regexp_extract(x, '^([a-z]*)', 1)), lambda w: w IN {S.in_list(VERBS)}) AS firsts FROM l),
    m AS (SELECT *, coalesce(list_max(list_transform({S.str_list(VERBS)}, lambda v: len(list_filter(firsts, lambda w: w = v)))), 0) AS most FROM k)
    SELECT doc_id, CASE WHEN len(l) < 6 THEN 0 ELSE least(6.0, least(4.0, (len(keys) - len(list_distinct(keys))) * 1.5) + CASE WHEN len(firsts) >= 4 AND most / len(firsts) >= 0.55 THEN 2 ELSE 0 END)::DOUBLE END AS penalty FROM m""",
)
def c12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.repetition_penalty(F.col("text"), VERBS).alias("penalty"))


FIRED = " UNION ALL ".join(f"SELECT o_orderkey, has_experience, {i} AS pos, {S.q(l)} AS label, {_d(p)} AS points, {S.q(r)} AS reason FROM signals WHERE {c}" for i, (l, p, c, r) in enumerate(Q.ARCHETYPE_RULES))


@query(
    "C13_classify_archetype",
    f"""WITH {SIGNALS_SQL}, labels AS (SELECT unnest([{_LABELS}]) AS label, unnest(range({len(Q.ARCHETYPE_LABELS)})) AS ord), fired AS ({FIRED}),
    pts AS (SELECT s.o_orderkey, s.has_experience, l.label, l.ord, coalesce(sum(f.points), 0) AS points FROM signals s CROSS JOIN labels l LEFT JOIN fired f ON f.o_orderkey = s.o_orderkey AND f.label = l.label GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY points DESC, ord) AS rn, lead(points) OVER (PARTITION BY o_orderkey ORDER BY points DESC, ord) AS nxt FROM pts),
    rs AS (SELECT o_orderkey, label, string_agg(reason, '|' ORDER BY pos) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, label ORDER BY pos) AS k FROM fired) WHERE k <= 3 GROUP BY ALL)
    SELECT rk.o_orderkey, CASE WHEN points < 26 THEN CASE WHEN has_experience THEN 'reverse_chronological' ELSE 'general_resume' END ELSE rk.label END AS archetype,
      CASE WHEN points < 26 THEN CASE WHEN has_experience THEN 0.64 ELSE 0.58 END::DOUBLE
        ELSE {S.rnd('least(CAST(0.93 AS DOUBLE), greatest(CAST(0.62 AS DOUBLE), CAST(0.6 AS DOUBLE) + points / 160 + least(points - nxt, 24) / 120))', 2)} END AS confidence,
      CASE WHEN points < 26 THEN CASE WHEN has_experience THEN 'some timeline' ELSE 'general structure' END ELSE reasons END AS reasons
    FROM rk LEFT JOIN rs ON rs.o_orderkey = rk.o_orderkey AND rs.label = rk.label WHERE rn = 1""",
)
def c13(spark, sf):
    out = signals(spark, sf).select("o_orderkey", Q.classify_archetype().alias("a"))
    return out.select("o_orderkey", "a.archetype", "a.confidence", F.array_join("a.reasons", "|").alias("reasons"))


@query(
    "C14_parser_confidence",
    f"""WITH {SIGNALS_SQL}, t AS (SELECT *, greatest(18, least(98, 92 - ({capped_sql(Q.CONFIDENCE_PENALTIES)} + {flags_sql(Q.CONFIDENCE_FLAGS)}) + CASE WHEN {Q.RECOVERED} THEN 12 ELSE 0 END + CASE WHEN section_count >= 4 THEN 4 ELSE 0 END))::DOUBLE AS score,
      array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {S.q(r)} END' for c, r in Q.RISK_REASONS)}], lambda x: x IS NOT NULL), '|') AS reasons FROM signals)
    SELECT o_orderkey, score, CASE WHEN score >= 78 THEN 'high' WHEN score >= 58 THEN 'medium' ELSE 'low' END AS label, coalesce(reasons, '') AS reasons FROM t""",
)
def c14(spark, sf):
    out = signals(spark, sf).select("o_orderkey", Q.parser_confidence().alias("c"))
    return out.select("o_orderkey", "c.score", "c.label", F.array_join("c.reasons", "|").alias("reasons"))


LOST_SQL = f"({capped_sql(Q.QUALITY_PENALTIES)} + {flags_sql(Q.QUALITY_FLAGS)})"


@query(
    "M9_document_quality",
    f"""WITH {SIGNALS_SQL}, t AS (SELECT *, 18 + {capped_sql(Q.QUALITY_COUNTS)} + {groups_sql(Q.QUALITY_RULES)} - repetition AS gained, {LOST_SQL} AS lost0 FROM signals)
    SELECT o_orderkey, {S.rnd('greatest(18, least(gained - CASE WHEN multi_column_detected AND explicit_header_count >= 4 THEN greatest(0, lost0 - 2) ELSE lost0 END, ' + caps_sql(Q.QUALITY_TOP, Q.QUALITY_CAPS) + '))', 4)} AS quality FROM t""",
)
def m9(spark, sf):
    return signals(spark, sf).select("o_orderkey", F.round(Q.document_quality(), 4).alias("quality"))


LAYOUT_SQL = " + ".join(f"CASE WHEN {Q.RECOVERED} THEN least({_d(k2)}, {c} * {_d(e2)}) ELSE least({_d(k1)}, {c} * {_d(e1)}) END" for c, e1, k1, e2, k2 in Q.ATS_LAYOUT_PENALTIES)


@query(
    "M10_ats_compliance",
    f"""WITH {SIGNALS_SQL} SELECT o_orderkey, {S.rnd(f'greatest(14, least(18 + {groups_sql(Q.ATS_RULES)} - ({capped_sql(Q.ATS_PENALTIES)} + {flags_sql(Q.ATS_FLAGS)} + {LAYOUT_SQL}), {caps_sql(Q.ATS_TOP, Q.ATS_CAPS)}))', 4)} AS ats FROM signals""",
)
def m10(spark, sf):
    return signals(spark, sf).select("o_orderkey", F.round(Q.ats_compliance(), 4).alias("ats"))


@query(
    "M9_text_evidence",
    f"""SELECT doc_id, {' + '.join(f'CAST(contains(lower(text), {S.q(v)}) AS DOUBLE)' for v in VERBS)} AS verb_hits,
      len(regexp_extract_all({S.unicode_words('text')}, {S.q(r'\b\d+%|\b\d+[kKmM]?\b')})) AS number_hits, len(regexp_extract_all({S.unicode_words('text')}, {S.q(Q.IMPACT.replace('(?iU)', '(?i)'))})) AS impact_hits FROM documents""",
)
def m9_text(spark, sf):
    found = Q.text_evidence(F.col("text"), VERBS)
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("M9_quality_by_label")
def m9_labels(spark, sf):
    """Agreement of the document score with the quality labels: mean score per label over all labelled documents."""
    from docmarket.catalog.structure import HEADERS
    from docmarket.plans.analysis import score_documents

    scored = score_documents(table(spark, sf, "documents").withColumn("content_type", F.lit("text/plain")), "doc_id", "text", HEADERS, F.lit("2024-05-17").cast("date"))
    labelled = scored.join(table(spark, sf, "labels"), ["doc_id"])
    return labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("resume_quality"), 4).alias("mean_quality"), F.round(F.avg("ats_compliance"), 4).alias("mean_ats"))
