"""Lexicon terms on documents and conversations; a word list of the tables' language is the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.catalog.text import sql_fold
from docmarket.functions import text as T
from docmarket.operators import terms as E
from docmarket.registry import query
from docmarket.sources.tables import table, values_frame

LEXICON = (
    ("the", "article"), ("der", "article"), ("les", "article"), ("of the", "of the"), ("that is", "that is"), ("is a", "is a"), ("with", "with"),
    ("und", "and"), ("and", "and"), ("it is", "it is"), ("for the", "for the"), ("que", "que"), ("The-Of", "of the"), ("in the of", "in the of"),
)
ALIASES = (("dashboards", "dashboarding"), ("red ring", "ruby band"), ("small-rod", "thin rod"), ("bluebolt", "azure bolt"), ("gear", "cog"), ("widget", "gadget"))
KNOWN = ("cold plate", "hot anvil", "thin rod", "new gizmo", "gears")


def lexicon(spark):
    return values_frame(spark, ["surface", "term"], LEXICON)


LEX_SQL = (
    "lex AS (SELECT DISTINCT grams, len(grams) AS n, term FROM (SELECT string_split("
    + sql_fold("surface") + f", ' ') AS grams, term FROM {S.values(['surface', 'term'], LEXICON)}))"
)


def hits_sql(source: str, keys: str, text: str, name: str = "hits") -> str:
    """CTE of (keys, pos, term): every n-gram of the folded text that is a surface."""
    return (
        f"{name}_w AS (SELECT {keys}, unnest(range(len(t))) AS pos, unnest(list_transform(range(1, len(t) + 1), lambda i: t[i:i + 3])) AS w FROM "
        f"(SELECT {keys}, string_split({sql_fold(text)}, ' ') AS t FROM {source})), "
        f"{name} AS (SELECT {keys}, pos, term FROM {name}_w JOIN lex ON w[1:n] = grams)"
    )


PART_LABELS = "(SELECT p_partkey, p_name FROM part UNION ALL SELECT -1 - p_partkey, split_part(p_name, ' ', 2) || 's' FROM part UNION ALL SELECT 1000000000 + p_partkey, replace(p_name, ' ', '_') FROM part)"


@query(
    "E1_canonicalize",
    f"""WITH a AS (SELECT {sql_fold('alias')} AS k, canonical AS v FROM {S.values(['alias', 'canonical'], ALIASES)}), kn AS (SELECT term AS k FROM {S.values(['term'], [(k,) for k in KNOWN])}),
    p AS (SELECT p_partkey, p_name, {sql_fold('p_name')} AS f FROM {PART_LABELS}),
    q AS (SELECT *, replace(f, ' ', '') AS c, regexp_replace(f, 's$', '') AS s FROM p)
    SELECT p_partkey, p_name, coalesce((SELECT v FROM a WHERE k = f), (SELECT k FROM kn WHERE k = f), (SELECT min(v) FROM a WHERE replace(k, ' ', '') = c),
      (SELECT min(k) FROM kn WHERE replace(k, ' ', '') = c), (SELECT v FROM a WHERE k = s), s) AS canonical FROM q""",
)
def e1(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    heads = part.select(-1 - F.col("p_partkey"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")))
    glued = part.select(F.col("p_partkey") + 1000000000, F.replace("p_name", F.lit(" "), F.lit("_")))
    labels = part.unionAll(heads).unionAll(glued)
    return E.canonicalize(labels, "p_name", values_frame(spark, ["alias", "canonical"], ALIASES), values_frame(spark, ["term"], [(k,) for k in KNOWN]))


@query("E2_match_terms", f"WITH {LEX_SQL}, {hits_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, count(*) AS n_hits, min(pos) AS first_pos FROM hits GROUP BY ALL")
def e2(spark, sf):
    return E.match_terms(table(spark, sf, "documents"), ["doc_id"], "text", lexicon(spark))


@query("E3_term_snippets")
def e3(spark, sf):
    return E.term_snippets(table(spark, sf, "documents"), ["doc_id"], "text", lexicon(spark))


WANTED_TERMS = ("article", "that is", "is a", "inthe", "o f", "with", "ofthe", "andthe")


@query(
    "E4_targeted_evidence",
    f"""WITH {LEX_SQL}, {hits_sql('conversations', 'conv_id, turn', 'text')}, want AS (SELECT conv_id, turn, term FROM conversations CROSS JOIN {S.values(['term'], [(t,) for t in WANTED_TERMS])}),
    pat AS (SELECT DISTINCT conv_id, turn, term FROM hits JOIN want USING (conv_id, turn, term)),
    miss AS (SELECT * FROM want EXCEPT SELECT * FROM pat),
    toks AS (SELECT conv_id, turn, string_split({sql_fold('text')}, ' ') AS t FROM conversations),
    grams AS (SELECT DISTINCT conv_id, turn, array_to_string(t[i:i + k], '') AS c FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM toks) CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(k) WHERE i + k <= len(t))
    SELECT conv_id, turn, term, 'pattern' AS mode FROM pat UNION ALL
    SELECT conv_id, turn, term, 'literal' FROM miss JOIN grams USING (conv_id, turn) WHERE replace(term, ' ', '') = c""",
)
def e4(spark, sf):
    turns = table(spark, sf, "conversations")
    wanted = turns.select("conv_id", "turn", F.explode(T.lit_array(WANTED_TERMS)).alias("term"))
    return E.targeted_evidence(turns, ["conv_id", "turn"], "text", lexicon(spark), wanted)


DECLARED_SQL = "declared AS (SELECT doc_id, lang AS term FROM documents UNION ALL SELECT doc_id, 'with' FROM documents WHERE doc_id % 4 = 0)"


@query("E5_term_inventory", f"WITH {LEX_SQL}, {hits_sql('documents', 'doc_id', 'text')}, {DECLARED_SQL} SELECT doc_id, term FROM declared UNION SELECT doc_id, term FROM hits")
def e5(spark, sf):
    docs = table(spark, sf, "documents")
    declared = docs.select("doc_id", F.col("lang").alias("term")).unionAll(docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("with")))
    return E.term_inventory(declared, E.match_terms(docs, ["doc_id"], "text", lexicon(spark)), "doc_id")


@query("E5_inventory_evidence")
def e5b(spark, sf):
    turns = turn_sections(spark, sf)
    snippets = E.term_snippets(turns, ["conv_id", "section"], "text", lexicon(spark))
    return E.inventory_evidence(snippets.drop("rank"), "conv_id")


# A conversation's turns are its sections.
TURN_SECTION = "CASE WHEN role = 'system' THEN 'summary' WHEN turn % 4 = 0 THEN 'skills' WHEN turn % 4 = 1 THEN 'education' WHEN turn % 4 = 2 THEN 'certifications' ELSE 'experience' END"


def turn_sections(spark, sf):
    turn = F.col("turn") % 4
    section = F.when(F.col("role") == "system", "summary").when(turn == 0, "skills").when(turn == 1, "education").when(turn == 2, "certifications").otherwise("experience")
    return table(spark, sf, "conversations").select("conv_id", section.alias("section"), "text")


SUPPORT_SQL = f"""turns AS (SELECT conv_id, {TURN_SECTION} AS section, text FROM conversations), {hits_sql('turns', 'conv_id, section', 'text')},
  once AS (SELECT DISTINCT conv_id, section, term FROM hits),
  agg AS (SELECT conv_id, term, bool_or(section = 'experience') AS high, sum(CASE section WHEN 'skills' THEN 0.32 WHEN 'education' THEN 0.4 WHEN 'certifications' THEN 0.5 WHEN 'summary' THEN 0.45 ELSE 1 END) AS score,
    count(*) AS n, bool_or(section NOT IN ('summary', 'skills')) AS outside FROM once GROUP BY ALL),
  support AS (SELECT conv_id, term, CASE WHEN high THEN 'strong' WHEN score >= 0.85 OR (n >= 2 AND outside) THEN 'medium' ELSE 'weak' END AS level FROM agg)"""


def support_frame(spark, sf):
    turns = turn_sections(spark, sf)
    hits = E.term_hits(turns, ["conv_id", "section"], F.col("text"), lexicon(spark))
    return E.section_support(hits, "conv_id")


@query("E6_section_support", f"WITH {LEX_SQL}, {SUPPORT_SQL} SELECT conv_id, term, level FROM support")
def e6(spark, sf):
    return support_frame(spark, sf)


@query(
    "E7_proof_weight",
    f"""WITH {LEX_SQL}, {SUPPORT_SQL}, have AS (SELECT DISTINCT conv_id, term FROM hits WHERE conv_id % 5 <> 0 OR term <> 'and'), ids AS (SELECT DISTINCT conv_id FROM conversations),
    want AS (SELECT conv_id, term FROM ids CROSS JOIN (SELECT DISTINCT term FROM lex))
    SELECT conv_id, term, CAST(CASE WHEN h.conv_id IS NULL THEN 0 WHEN level = 'strong' THEN 1 WHEN level = 'medium' THEN 0.72 ELSE 0.38 END AS DOUBLE) AS proof
    FROM want LEFT JOIN (SELECT conv_id, term FROM have) h USING (conv_id, term) LEFT JOIN support USING (conv_id, term)""",
)
def e7(spark, sf):
    turns = turn_sections(spark, sf)
    hits = E.term_hits(turns, ["conv_id", "section"], F.col("text"), lexicon(spark))
    have = hits.filter("conv_id % 5 <> 0 OR term <> 'and'").select("conv_id", "term")
    terms = sorted({t for _, t in LEXICON})
    wanted = turns.select("conv_id").distinct().select("conv_id", F.explode(T.lit_array(terms)).alias("term"))
    return E.with_proof(wanted, have, E.section_support(hits, "conv_id"), "conv_id")
