"""Document structure and dated experience on documents, conversations and orders.

The prose of the tables is in an invented language, so frequent words of that
language stand in for header aliases, verbs and context words; all of these are
arguments of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.functions import text as T
from docmarket.operators import structure as C, temporal as D
from docmarket.registry import query
from docmarket.sources.tables import table

TABLE_HEADERS = {
    "experience": ("the", "die", "of the", "on"),
    "projects": ("that is", "with", "en"),
    "education": ("ein", "la", "it"),
    "skills": ("of", "and", "que"),
    "teaching": ("is", "der"),
    "research": ("to", "le"),
}
HEADERS = C.Headers(TABLE_HEADERS)
VERBS = ("the", "and", "for", "was", "ein", "que", "les")
BULLET = r"^(?:[A-D]|\d+[\).])\S*\s+"
EDU, WORK = r"\b(this|are|und|de)\b", r"\b(from|at|el|un)\b"

LINES = (
    f"list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]+'), "
    f"lambda x: regexp_replace(x, {S.q('^' + S.SPACE + '+|' + S.SPACE + '+$')}, '', 'g')), lambda x: x <> '')"
).replace("{{", "{").replace("}}", "}")
LINES_SQL = f"lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, {LINES} AS l FROM documents))"
ALIASES = S.in_list(HEADERS.section)
ALIAS_MAP = "MAP {" + ", ".join(f"{S.q(k)}: {S.q(v)}" for k, v in HEADERS.section.items()) + "}"
BARE = "regexp_replace(lower(line), '^:+|:+$', '', 'g')"
PACKED = f"list_filter(regexp_split_to_array(replace({BARE}, '&', ' '), {S.q(S.SPACE + '+')}), lambda t: t <> '')"
DELIM, PREFIX = f"(?i)^({HEADERS.any})\\s*[:|\\-]\\s*(.+)$", f"(?i)^({HEADERS.any})\\s+(.+)$"
HEADS_SQL = f"""heads AS (SELECT doc_id, line_no, line,
  CASE WHEN {BARE} IN {ALIASES} THEN {ALIAS_MAP}[{BARE}]
       WHEN regexp_matches(line, {S.q(DELIM)}) THEN {ALIAS_MAP}[lower(regexp_extract(line, {S.q(DELIM)}, 1))]
       WHEN regexp_matches(line, {S.q(PREFIX)}) THEN {ALIAS_MAP}[lower(regexp_extract(line, {S.q(PREFIX)}, 1))]
       WHEN len({PACKED}) > 0 AND len(list_filter({PACKED}, lambda t: t NOT IN {ALIASES})) = 0 THEN {ALIAS_MAP}[({PACKED})[1]] END AS section,
  CASE WHEN {BARE} IN {ALIASES} THEN '' WHEN regexp_matches(line, {S.q(DELIM)}) THEN regexp_extract(line, {S.q(DELIM)}, 2)
       WHEN regexp_matches(line, {S.q(PREFIX)}) THEN regexp_extract(line, {S.q(PREFIX)}, 2) ELSE '' END AS rest FROM lines)"""
PARTS_SQL = f"""{LINES_SQL}, {HEADS_SQL},
parts AS (SELECT doc_id, line_no, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'summary') AS section,
  CASE WHEN section IS NULL THEN line ELSE rest END AS line FROM heads),
content AS (SELECT * FROM parts WHERE line <> '' AND lower(line) NOT IN {ALIASES})"""
# Headers inside a line: every marked place of every alias, taken by length, then from the left, if it overlaps none taken before.
BY_LENGTH = sorted(HEADERS.section, key=len, reverse=True)
INLINE_SQL = f"""{LINES_SQL}, {HEADS_SQL}, alias(a, turn, section) AS (VALUES {', '.join(f"({S.q(a)}, {n}, {S.q(HEADERS.section[a])})" for n, a in enumerate(BY_LENGTH))}),
cuts AS (SELECT doc_id, line_no, line, a, turn, section, string_split(lower(line), a) AS p FROM lines JOIN alias ON contains(lower(line), a)),
spots AS (SELECT * EXCLUDE (p, k), CAST(list_sum(list_transform(p[1:k], lambda x: len(x))) + (k - 1) * len(a) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cuts)),
marked AS (SELECT doc_id, line_no, s, s + len(a) AS e, section, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY turn, s) AS t FROM spots
  WHERE NOT regexp_matches(substr(line, s, CASE WHEN s = 0 THEN 0 ELSE 1 END), '[A-Za-z]') AND NOT regexp_matches(substr(line, s + len(a) + 1, 1), '[A-Za-z]')
    AND (s = 0 OR len(regexp_replace(substr(line, s + 1, len(a)), '[^A-Z]', '', 'g')) * 5 >= len(regexp_replace(a, '[^a-z]', '', 'g')) * 4
      OR regexp_matches(substr(line, greatest(s - 2, 1), least(s, 3)), '[:|•-]\\s*$') OR regexp_matches(substr(line, s + len(a) + 1, 2), '^\\s*[:|-]'))),
scan AS (SELECT doc_id, line_no, CAST(0 AS BIGINT) AS t, CAST([] AS STRUCT(s BIGINT, e BIGINT, section VARCHAR)[]) AS taken FROM (SELECT DISTINCT doc_id, line_no FROM marked)
  UNION ALL SELECT c.doc_id, c.line_no, m.t, CASE WHEN len(list_filter(c.taken, lambda x: m.s < x.e AND m.e > x.s)) = 0
    THEN list_append(c.taken, {{'s': m.s, 'e': m.e, 'section': m.section}}) ELSE c.taken END FROM scan c JOIN marked m ON m.doc_id = c.doc_id AND m.line_no = c.line_no AND m.t = c.t + 1),
ends AS (SELECT doc_id, line_no, arg_max(taken, t) AS taken FROM scan GROUP BY doc_id, line_no),
places AS (SELECT doc_id, line_no, len(taken) AS n, unnest(taken) AS x FROM ends),
cutouts AS (SELECT doc_id, line_no, n, x.s AS s, x.section AS section,
  trim(substr(line, x.e + 1, coalesce(lead(x.s) OVER (PARTITION BY doc_id, line_no ORDER BY x.s), len(line)) - x.e), ' :-') AS content FROM places JOIN lines USING (doc_id, line_no)),
inner_heads AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY s) - 1 AS pos, section, content FROM cutouts WHERE n > 1 OR s > 0)"""
INLINE_PARTS_SQL = f"""{INLINE_SQL},
entries AS (SELECT * FROM inner_heads UNION ALL SELECT doc_id, line_no, 0, section, CASE WHEN section IS NULL THEN line ELSE rest END
  FROM heads h WHERE NOT EXISTS (SELECT 1 FROM inner_heads i WHERE i.doc_id = h.doc_id AND i.line_no = h.line_no)),
parts AS (SELECT doc_id, line_no, pos, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no, pos), 'summary') AS section, content AS line FROM entries),
content AS (SELECT * FROM parts WHERE line <> '' AND lower(line) NOT IN {ALIASES})"""


@query("C1_explode_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines")
def c1(spark, sf):
    return C.explode_lines(table(spark, sf, "documents"), "doc_id", "text")


@query("C2_detect_headers", f"WITH {LINES_SQL}, {HEADS_SQL} SELECT doc_id, line_no, section, rest AS content FROM heads WHERE section IS NOT NULL")
def c2(spark, sf):
    lines = C.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    return C.detect_headers(lines, HEADERS, ["doc_id", "line_no"])


@query("C3_split_inline_headers", f"WITH RECURSIVE {INLINE_SQL} SELECT doc_id, line_no, pos, section, content FROM inner_heads")
def c3(spark, sf):
    lines = C.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    return C.split_inline_headers(lines, HEADERS, ["doc_id", "line_no"])


@query(
    "C4_assign_sections",
    f"WITH {PARTS_SQL} SELECT doc_id, section, {S.ws(chr(39).join(['string_agg(line, ', ' ', ' ORDER BY line_no)']))} AS text FROM content GROUP BY doc_id, section",
)
def c4(spark, sf):
    return C.assign_sections(table(spark, sf, "documents"), "doc_id", "text", HEADERS, inline=False)


@query(
    "C4_assign_sections_inline",
    f"WITH RECURSIVE {INLINE_PARTS_SQL} SELECT doc_id, section, {S.ws(chr(39).join(['string_agg(line, ', ' ', ' ORDER BY line_no, pos)']))} AS text FROM content GROUP BY doc_id, section",
)
def c4_inline(spark, sf):
    return C.assign_sections(table(spark, sf, "documents"), "doc_id", "text", HEADERS)


TOP_WORDS_SQL = f"list_sort(list_distinct(list_filter(string_split({S.clean_words('text')}, ' '), lambda t: t IN ('the', 'of', 'der', 'que', 'les', 'and', 'with', 'for'))))"


@query(
    "C5_synthesize_section",
    f"WITH {PARTS_SQL}, has AS (SELECT DISTINCT doc_id FROM content WHERE section = 'skills'), "
    f"d AS (SELECT doc_id, 'skills ' || text AS body, {TOP_WORDS_SQL} AS terms FROM documents) "
    "SELECT doc_id, array_to_string(terms[1:3], ', ') AS text, true AS synthetic FROM d WHERE doc_id NOT IN (SELECT doc_id FROM has) AND len(terms) > 0 "
    "UNION ALL SELECT doc_id, '', false FROM has",
)
def c5(spark, sf):
    words = ("the", "of", "der", "que", "les", "and", "with", "for")
    docs = table(spark, sf, "documents")
    sections = C.part_sections(C.parse_documents(docs, "doc_id", "text", HEADERS, inline=False), "doc_id")
    terms = F.array_sort(F.array_distinct(F.filter(F.split(T.clean_words(F.col("text")), " "), lambda t: t.isin(*words))))
    named = docs.select("doc_id", F.concat(F.lit("skills "), "text").alias("body"), terms.alias("terms"))
    out = C.synthesize_section(sections, named, "doc_id", "body", F.col("terms"), limit=3)
    return out.filter("section = 'skills'").select("doc_id", F.when(F.col("synthetic"), F.col("text")).otherwise("").alias("text"), "synthetic")


COUNTS_SQL = ", ".join(f"CAST(coalesce(sum(CASE WHEN section = '{s}' THEN n END), 0) AS BIGINT) AS {s}_section_word_count" for s in C.COUNTED_SECTIONS)
WC = lambda s: f"{s}_section_word_count"
TOTAL_SQL, EV_SQL = " + ".join(WC(s) for s in C.COUNTED_SECTIONS), " + ".join(WC(s) for s in C.EVIDENCE_SECTIONS)


SHAPE_SQL = f"""w AS (SELECT doc_id, section, len({S.words('line')}) AS n FROM content), c AS (SELECT doc_id, {COUNTS_SQL} FROM w GROUP BY doc_id),
    b AS (SELECT *, {TOTAL_SQL} AS total, {EV_SQL} AS evidence, list_filter([{', '.join(WC(s) for s in C.BALANCED_SECTIONS)}], lambda x: x > 0) AS filled FROM c),
    m AS (SELECT *, list_avg(filled) AS m FROM b)
    SELECT {', '.join(['doc_id'] + [WC(s) for s in C.COUNTED_SECTIONS])},
      CASE WHEN total > 0 THEN {S.rnd('greatest(' + ', '.join(WC(s) for s in C.COUNTED_SECTIONS) + ') / total', 3)} ELSE 0 END AS dominant_section_share,
      CASE WHEN total > 0 THEN {S.rnd('skills_section_word_count / total', 3)} ELSE 0 END AS skills_focus_share,
      CASE WHEN evidence > 0 THEN {S.rnd('projects_section_word_count / evidence', 3)} ELSE 0 END AS project_focus_share,
      CASE WHEN len(filled) = 0 THEN 0 ELSE {S.rnd('100.0 - least(100.0, list_avg(list_transform(filled, lambda x: abs(x - m))) / greatest(m, 1.0) * 55.0)', 2)} END AS section_balance_score FROM m"""


@query("C6_section_shape", f"WITH {PARTS_SQL}, {SHAPE_SQL}")
def c6(spark, sf):
    return C.section_shape(C.section_lines(table(spark, sf, "documents"), "doc_id", "text", HEADERS, inline=False), "doc_id")


@query("C6_section_shape_inline", f"WITH RECURSIVE {INLINE_PARTS_SQL}, {SHAPE_SQL}")
def c6_inline(spark, sf):
    return C.section_shape(C.section_lines(table(spark, sf, "documents"), "doc_id", "text", HEADERS), "doc_id")


EVIDENCE = S.in_list(C.EVIDENCE_SECTIONS)
VERB_PATTERN = r"(?i)\b(" + "|".join(VERBS) + r")\b"
FLAGS_SQL = f"""flags AS (SELECT doc_id, section, section IN {EVIDENCE} AS ev, regexp_matches(line, {S.q(BULLET)}) AS b, regexp_matches({S.ascii_words('line')}, {S.q(r'\b\d[\d,]*\b|%')}) AS q,
  regexp_matches({S.ascii_words('line')}, {S.q(VERB_PATTERN)}) AS a, len({S.words('line')}) AS n, regexp_extract_all(lower({S.ascii_words('line')}), {S.q(VERB_PATTERN)}) AS verbs FROM content)"""


SIGNALS_SQL = f"""{FLAGS_SQL}, v AS (SELECT doc_id, count(DISTINCT verb) AS k FROM (SELECT doc_id, unnest(verbs) AS verb FROM flags WHERE ev) GROUP BY doc_id)
    SELECT f.doc_id, count(*) FILTER (section = 'summary') AS summary_line_count, count(*) FILTER (b AND section = 'experience') AS experience_bullet_count,
      count(*) FILTER (b AND section = 'projects') AS project_bullet_count, count(*) FILTER (b AND ev) AS evidence_bullet_count,
      count(*) FILTER (q AND section = 'experience') AS experience_quantified_line_count, count(*) FILTER (q AND section = 'projects') AS projects_quantified_line_count,
      count(*) FILTER (q AND ev) AS evidence_quantified_line_count, count(*) FILTER (a AND section = 'experience') AS experience_action_line_count,
      count(*) FILTER (a AND section = 'projects') AS projects_action_line_count, count(*) FILTER (a AND ev) AS evidence_action_line_count,
      count(*) FILTER (ev AND n >= 34) AS long_evidence_line_count, count(*) FILTER (ev AND b AND n <= 5) AS short_bullet_count,
      count(*) FILTER (ev AND b AND NOT a AND NOT q) AS weak_bullet_count,
      {S.rnd('coalesce(avg(n) FILTER (ev), 0)', 2)} AS avg_evidence_line_word_count, {S.rnd('coalesce(avg(n) FILTER (ev AND b), 0)', 2)} AS avg_bullet_word_count,
      coalesce(max(k), 0) AS action_verb_variety_count FROM flags f LEFT JOIN v USING (doc_id) GROUP BY f.doc_id"""


@query("C7_line_signals", f"WITH {PARTS_SQL}, {SIGNALS_SQL}")
def c7(spark, sf):
    lines = C.section_lines(table(spark, sf, "documents"), "doc_id", "text", HEADERS, inline=False)
    return C.line_signals(lines, "doc_id", VERBS, BULLET)


@query("C7_line_signals_inline", f"WITH RECURSIVE {INLINE_PARTS_SQL}, {SIGNALS_SQL}")
def c7_inline(spark, sf):
    lines = C.section_lines(table(spark, sf, "documents"), "doc_id", "text", HEADERS)
    return C.line_signals(lines, "doc_id", VERBS, BULLET)


@query(
    "C8_header_signals",
    f"""WITH {LINES_SQL}, m AS (SELECT doc_id, {BARE} IN {ALIASES} AS whole, regexp_matches({BARE}, {S.q(f'^({HEADERS.any}) ')}) AS starts,
      len(list_filter(regexp_split_to_array(replace({BARE}, '&', ' '), {S.q(S.SPACE + '+')}), lambda t: t IN {ALIASES})) >= 2 AS merged,
      regexp_matches({S.ascii_words('line')}, {S.q(r'\b\d[\d,]*\b|%')}) AS q, regexp_matches(line, {S.q(C.BULLET)}) AS b, len({S.words('line')}) AS n FROM lines)
    SELECT doc_id, count(*) FILTER (whole) AS explicit_header_count, count(*) FILTER (starts) AS inline_header_count, count(*) FILTER (merged) AS merged_header_count,
      count(*) FILTER (q) AS quantified_line_count, count(*) FILTER (b) AS bullet_like_line_count, count(*) FILTER (n >= 34 AND NOT b) AS dense_paragraph_line_count FROM m GROUP BY doc_id""",
)
def c8(spark, sf):
    lines = C.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    return C.header_signals(lines, "doc_id", HEADERS, inline=False)


@query(
    "C8_header_signals_inline",
    f"""WITH RECURSIVE {INLINE_SQL}, k AS (SELECT doc_id, line_no, CASE WHEN len(taken) > 1 THEN len(taken) ELSE 0 END AS n_inline FROM ends),
    m AS (SELECT doc_id, coalesce(n_inline, 0) AS n_inline, CASE WHEN {BARE} IN {ALIASES} THEN 1 ELSE 0 END AS whole, CASE WHEN regexp_matches({BARE}, {S.q(f'^({HEADERS.any}) ')}) THEN 1 ELSE 0 END AS starts,
      len(list_filter(regexp_split_to_array(replace({BARE}, '&', ' '), {S.q(S.SPACE + '+')}), lambda t: t IN {ALIASES})) >= 2 AS merged,
      regexp_matches({S.ascii_words('line')}, {S.q(r'\b\d[\d,]*\b|%')}) AS q, regexp_matches(line, {S.q(C.BULLET)}) AS b, len({S.words('line')}) AS n FROM lines LEFT JOIN k USING (doc_id, line_no))
    SELECT doc_id, CAST(sum(n_inline + whole) AS BIGINT) AS explicit_header_count, CAST(sum(n_inline + starts) AS BIGINT) AS inline_header_count, count(*) FILTER (merged) AS merged_header_count,
      count(*) FILTER (q) AS quantified_line_count, count(*) FILTER (b) AS bullet_like_line_count, count(*) FILTER (n >= 34 AND NOT b) AS dense_paragraph_line_count FROM m GROUP BY doc_id""",
)
def c8_inline(spark, sf):
    lines = C.explode_lines(table(spark, sf, "documents"), "doc_id", "text")
    return C.header_signals(lines, "doc_id", HEADERS)


@query(
    "C9_section_leakage",
    f"""WITH {PARTS_SQL} SELECT doc_id, max(CASE WHEN section = 'experience' AND regexp_matches({S.ascii_words('line')}, {S.q('(?i)' + EDU)}) THEN 1 ELSE 0 END)
      + max(CASE WHEN section = 'education' AND regexp_matches({S.ascii_words('line')}, {S.q('(?i)' + WORK)}) THEN 1 ELSE 0 END) AS section_leakage_count FROM content GROUP BY doc_id""",
)
def c9(spark, sf):
    lines = C.section_lines(table(spark, sf, "documents"), "doc_id", "text", HEADERS, inline=False)
    return C.section_leakage(lines, "doc_id", EDU, WORK)


# Order lines written as dated work entries, one text per order.
ENTRY_SQL = """CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%b %Y') || ' - ' || strftime(l_shipdate + INTERVAL 200 DAY, '%b %Y')
  WHEN 1 THEN strftime(l_shipdate, '%m/%Y') || ' to ' || strftime(l_shipdate + INTERVAL 200 DAY, '%m/%Y') ELSE strftime(l_shipdate, '%Y') || '-present' END"""


def entry_text(day="l_shipdate"):
    start, end = F.col(day).cast("date"), F.date_add(F.col(day).cast("date"), 200)
    kind = F.col("l_linenumber") % 3
    return (
        F.when(kind == 0, F.concat(F.date_format(start, "MMM yyyy"), F.lit(" - "), F.date_format(end, "MMM yyyy")))
        .when(kind == 1, F.concat(F.date_format(start, "MM/yyyy"), F.lit(" to "), F.date_format(end, "MM/yyyy")))
        .otherwise(F.concat(F.date_format(start, "yyyy"), F.lit("-present")))
    )


@query(
    "C10_chronology_signals",
    f"""WITH e AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT doc_id, n AS date_range_count, n + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS chronology_signal_count FROM e""",
)
def c10(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), entry_text().alias("e"))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.collect_list("e"), "; ").alias("body"))
    body = F.concat("body", F.when(F.col("doc_id") % 2 == 0, F.lit(" over 7+ Years")).otherwise(""))
    ranges, chronology = C.chronology_signals(body)
    return docs.select("doc_id", ranges.alias("date_range_count"), chronology.alias("chronology_signal_count"))


@query("C11_parse_signals")
def c11(spark, sf):
    out = C.parse_signals(table(spark, sf, "documents"), "doc_id", "text", HEADERS)
    return out.withColumn("section_names", F.array_join(F.sort_array("section_names"), ","))


# --- intervals --------------------------------------------------------------------

SECTION_OF = "CASE l_linenumber % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'projects' WHEN 2 THEN 'summary' ELSE 'education' END"
WORDS_OF = "CASE WHEN l_quantity < 15 THEN 'engineer at' WHEN l_quantity < 25 THEN 'university' WHEN l_quantity < 35 THEN 'thesis' ELSE 'stay' END"
RANGE_START = "CASE l_linenumber % 3 WHEN 2 THEN date_trunc('year', l_shipdate) ELSE date_trunc('month', l_shipdate) END"
RANGE_END = "CASE l_linenumber % 3 WHEN 2 THEN DATE '2024-05-01' ELSE date_trunc('month', l_shipdate + INTERVAL 200 DAY) END"
# a calendar year range ends in the month named by "present"
RANGES_SQL = f"""ranges AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, {SECTION_OF} AS section, {WORDS_OF} AS words, {RANGE_START} AS s, {RANGE_END} AS e FROM lineitem),
signs AS (SELECT *, section IN ('experience') OR words = 'engineer at' AS work, section = 'projects' OR words = 'thesis' AS proj, words = 'university' AS edu FROM ranges),
kept AS (SELECT *, CASE WHEN section = 'projects' OR (section = 'summary' AND NOT work) THEN 'project' ELSE 'primary' END AS bucket FROM signs
  WHERE (work OR proj) AND NOT (edu AND section <> 'projects') AND s <= e)"""


def entries(spark, sf):
    sections = ("experience", "projects", "summary", "education")
    section = F.element_at(T.lit_array(sections), (F.col("l_linenumber") % 4 + 1).cast("int"))
    quantity = F.col("l_quantity")
    word = F.when(quantity < 15, "engineer at").when(quantity < 25, "university").when(quantity < 35, "thesis").otherwise("stay")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", section.alias("section"), F.concat(word, F.lit(" "), entry_text()).alias("text")
    )


def found_ranges(spark, sf):
    return D.extract_date_ranges(entries(spark, sf), ["doc_id", "l_linenumber", "l_partkey", "section"], "text", F.lit("2024-05-17").cast("date"))


@query(
    "D1_extract_date_ranges",
    f"WITH {RANGES_SQL} SELECT doc_id, l_linenumber, l_partkey, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, "
    "words || ' ' AS before FROM ranges",
)
def d1(spark, sf):
    return found_ranges(spark, sf).select("doc_id", "l_linenumber", "l_partkey", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "before")


@query("D2_classify_range", f"WITH {RANGES_SQL} SELECT doc_id, l_linenumber, l_partkey, bucket FROM kept")
def d2(spark, sf):
    return D.classify_range(found_ranges(spark, sf)).select("doc_id", "l_linenumber", "l_partkey", "bucket")


# Stays of a customer: order date to last ship date.
STAYS_SQL = """stays AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INTEGER) AS e FROM orders),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM stays),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e) AS island FROM marked)"""


@query("D3_merge_intervals", f"WITH {STAYS_SQL} SELECT k, strftime(min(s), '%Y-%m-%d') AS s, strftime(max(e), '%Y-%m-%d') AS e FROM islands GROUP BY k, island")
def d3(spark, sf):
    day = F.col("o_orderdate").cast("date")
    stays = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 300).cast("int")).alias("e"))
    return D.merge_intervals(stays, ["k"], "s", "e").select("k", F.col("s").cast("string").alias("s"), F.col("e").cast("string").alias("e"))


@query(
    "D4_experience_years",
    f"""WITH {RANGES_SQL}, f AS (SELECT DISTINCT doc_id FROM ranges WHERE section <> 'education'), k2 AS (SELECT * FROM kept WHERE section <> 'education'),
    m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id, bucket ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM k2),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, bucket ORDER BY s, e) AS island FROM m),
    g AS (SELECT doc_id, bucket, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, bucket, island),
    n AS (SELECT doc_id, bucket, (year(e) - year(s)) * 12 + month(e) - month(s) + 1 AS months FROM g),
    t AS (SELECT doc_id, {S.rnd("(coalesce(sum(months) FILTER (bucket = 'primary'), 0) + least(coalesce(sum(months) FILTER (bucket = 'project'), 0) * CAST(0.55 AS DOUBLE), 12.0)) / 12", 2)} AS y FROM n GROUP BY doc_id)
    SELECT doc_id, coalesce(y, 0) AS experience_years FROM f LEFT JOIN t USING (doc_id)""",
)
def d4(spark, sf):
    return D.experience_years(entries(spark, sf), "doc_id", F.lit("2024-05-17").cast("date"))
