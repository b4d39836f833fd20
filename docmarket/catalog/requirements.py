"""Requirement profiles on conversation turns, part names and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.catalog.roles import FAM_SQL, HINTS_SQL, LEX as ROLES, MODEL_SQL, NORMAL_SQL, hints_frame, parts_frame
from docmarket.catalog.terms import LEX_SQL, hits_sql, lexicon
from docmarket.functions import text as T
from docmarket.operators import requirements as Q, taxonomy as R, terms as E
from docmarket.registry import query
from docmarket.sources.tables import table, values_frame

LEX = Q.RequirementLexicon(required=("des", "der "), preferred=("the", "que"), duties=("and", "en "), low_signal=("zzz", "qui"), heads=("and", "que", "der"), soft=("is a",), noise=("red rod",))

TURNS_SQL = f"""turns AS (SELECT conv_id * 1000 + turn AS listing_id, role AS title, text FROM conversations),
  sents AS (SELECT listing_id, title, unnest(range(len(s))) AS sent_no, unnest(s) AS sentence FROM (SELECT listing_id, title, list_filter(list_transform(string_split(regexp_replace({S.ws('text')}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM turns)),
  good AS (SELECT * FROM sents WHERE NOT regexp_matches(lower(sentence), 'zzz|qui'))"""


def turns(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("listing_id"), F.col("role").alias("title"), "text")


@query("E8_candidate_phrases")
def e8(spark, sf):
    return Q.candidate_phrases(turns(spark, sf), "listing_id", "title", "text", LEX)


KNOWN = ("red ring", "blue", "hot", "gear", "plate", "small rod", "new")
LABEL_FORMS = ("{}", "{} and {}", "strong {}", "{} support", "{} level", "{} cloud network access", "the of {}", "{} engineer", "12", "{} experience")
FORMS_SQL = "(" + S.str_list(LABEL_FORMS) + ")[CAST(p_partkey % 10 AS BIGINT) + 1]"


def valid_sql(t: str) -> str:
    w = f"string_split({t}, ' ')"
    known, allowed, comp = S.in_list(KNOWN), S.in_list(X.ALLOWED_SINGLETONS), S.in_list(X.ALLOWED_COMPONENTS)
    content = f"list_filter({w}, lambda x: x NOT IN {S.in_list(X.FILLER_TOKENS + ('in',))})"
    has = lambda l, words: f"len(list_filter({l}, lambda x: x IN {words})) > 0"
    return f"""length({t}) >= 2 AND regexp_matches({t}, '[a-z]') AND NOT regexp_full_match({t}, '\\d+(\\.\\d+)?') AND {t} NOT IN {S.in_list(tuple(LEX.soft) + X.GENERIC_ROLE_TERMS + tuple(LEX.noise))} AND NOT suffix({t}, ' level')
      AND NOT regexp_matches({t}, {S.q('^(' + '|'.join(X.NON_TERM_OPENERS) + ')')}) AND NOT (len({w}) = 1 AND {t} NOT IN {known} AND {t} NOT IN {allowed}) AND NOT ({has(w, S.in_list(X.GENERIC_SINGLETONS))} AND {t} NOT IN {known})
      AND NOT {has(w, S.in_list(X.BLOCKED_TOKENS))} AND {w}[len({w})] NOT IN {S.in_list(X.GENERIC_ROLE_TERMS)} AND len({w}) <= 5
      AND ({t} IN {known} OR len({w}) < 2 OR (len({content}) <= 3 AND ({has(content, known)} OR {has(content, S.in_list(X.ANCHOR_TOKENS))}) AND len(list_filter({content}, lambda x: x NOT IN {known} AND x NOT IN {allowed} AND x NOT IN {comp})) = 0))
      AND len(list_filter({w}, lambda x: x IN {S.in_list(X.FILLER_TOKENS)})) / len({w}) <= 0.5"""


@query("E9_valid_candidate", f"WITH t AS (SELECT p_partkey, replace({FORMS_SQL}, '{{}}', CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END) AS term FROM part) SELECT p_partkey, term FROM t WHERE {valid_sql('term')}")
def e9(spark, sf):
    word = F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    form = F.element_at(T.lit_array(LABEL_FORMS), (F.col("p_partkey") % 10 + 1).cast("int"))
    labels = table(spark, sf, "part").select("p_partkey", F.replace(form, F.lit("{}"), word).alias("term"))
    return labels.filter(Q.valid_candidate(F.col("term"), KNOWN, LEX))


MARK = lambda e, r, p, d, o: f"CASE WHEN regexp_matches({e}, 'des|der ') THEN {r} WHEN regexp_matches({e}, 'the|que') THEN {p} WHEN regexp_matches({e}, 'and|en ') THEN {d} ELSE {o} END"


@query(
    "E10_pattern_weights",
    f"""WITH {LEX_SQL}, {TURNS_SQL}, {hits_sql('good', 'listing_id, title, sent_no, sentence', 'sentence')}, once AS (SELECT DISTINCT listing_id, title, sent_no, sentence, term FROM hits)
    SELECT listing_id, term, {S.rnd("max(CAST(0.36 AS DOUBLE) + CASE WHEN contains(title, term) THEN 0.18 ELSE 0 END + " + MARK('lower(sentence)', 0.34, 0.16, 0.08, 0.04) + ")", 2)} AS weight, count(*) AS n FROM once WHERE term <> 'is a' GROUP BY ALL""",
)
def e10(spark, sf):
    rows = Q.sentences(turns(spark, sf), ["listing_id", "title"], F.col("text"), LEX)
    hits = E.term_hits(rows, ["listing_id", "title", "sent_no", "sentence"], F.col("sentence"), lexicon(spark)).dropDuplicates(["listing_id", "sent_no", "term"])
    return Q.pattern_weights(hits.withColumnRenamed("sentence", "snippet"), "listing_id", LEX)


TITLE_TABLE = (("red ring", "sql", 0.54), ("ring", "excel", 0.48), ("blue", "sql", 0.62), ("hot gizmo", "etl", 0.72), ("bolt", "iam", 0.5), ("gizmo", "etl", 0.4))
IMPLIED = tuple((f"{a} ring", b, w) for a, b, w in (("red", "sql", 0.72), ("red", "etl", 0.3), ("blue", "sql", 0.28), ("hot", "crm", 0.58)))


@query(
    "E11_title_implied",
    f"SELECT p_partkey, term, max(weight) AS weight, count(*) AS n FROM part JOIN {S.values(['phrase', 'term', 'weight'], TITLE_TABLE)} ON contains(' ' || p_name || ' ', ' ' || phrase || ' ') GROUP BY ALL",
)
def e11(spark, sf):
    return Q.title_implied(table(spark, sf, "part"), "p_partkey", "p_name", values_frame(spark, ["phrase", "term", "weight"], TITLE_TABLE))


@query(
    "E11_implied_terms",
    f"WITH x AS (SELECT DISTINCT l_orderkey, p_name AS term FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, implied AS term, max(weight) AS weight, count(*) AS n FROM x JOIN {S.values(['term', 'implied', 'weight'], IMPLIED)} USING (term) GROUP BY ALL",
)
def e11_implied(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.col("p_name").alias("term"))
    return Q.implied_terms(lines, "l_orderkey", values_frame(spark, ["term", "implied", "weight"], IMPLIED))


PROXY = {"pandas": (r"\bthe\b", r"\bdas\b"), "sql": (r"\bque\b",), "excel": (r"\bunds?\b",)}
CONTEXT = {"pandas": ("of", "is"), "excel": ("nonesuch",)}


def _proxy_sql(term):
    rx = "|".join(f"({p})" for p in PROXY[term])
    near = "true" if term not in CONTEXT else f"regexp_matches(lower(sentence), '{'|'.join(CONTEXT[term])}')"
    extra = f" + CASE WHEN {near} THEN 0.08 ELSE 0 END" if term in CONTEXT else ""
    return (
        f"SELECT listing_id, '{term}' AS term, CAST(0.24 AS DOUBLE) + {MARK('lower(sentence)', 0.22, 0.12, 0.06, 0)}{extra} AS w FROM good "
        f"WHERE regexp_matches({S.ascii_words('lower(sentence)')}, {S.q(rx)}) AND ({near} OR contains(lower(sentence), title))"
    )


@query("E11_proxy_terms", f"WITH {TURNS_SQL}, p AS ({' UNION ALL '.join(_proxy_sql(t) for t in PROXY)}) SELECT listing_id, term, {S.rnd('max(w)', 2)} AS weight, count(*) AS n FROM p GROUP BY ALL")
def e11_proxy(spark, sf):
    return Q.proxy_terms(turns(spark, sf), "listing_id", "title", "text", PROXY, CONTEXT, LEX)


SPECIAL = (Q.Specialism(("urgent", "high"), ("red ring", "blue bolt", "hot gear"), ("old rod", "small bolt")), Q.Specialism(("low",), ("cold plate",), ("new anvil",)))
SCIENCE = Q.Specialism(("medium", "high"), ("hot gear", "cold widget"), ("old rod", "new gizmo"))
_special = lambda s, terms: f"regexp_matches(low_title, '{'|'.join(s.patterns)}') AND term IN {S.in_list(terms)}"
CONTRIB_SQL = """con AS (SELECT l_orderkey AS listing_id, lower(o_orderpriority) AS low_title, p_name AS term, max(0.2 + l_discount * 5) AS base, count(*) AS n, bool_or(l_returnflag = 'R') AS extracted FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""
PROFILE_SQL = f"""{CONTRIB_SQL}, w1 AS (SELECT *, least(1, base + least(0.12, (n - 1) * 0.06)) AS w FROM con), w2 AS (SELECT *, CASE WHEN {_special(SCIENCE, SCIENCE.core)} THEN least(1, w + 0.05) ELSE w END AS wa FROM w1),
  w3 AS (SELECT *, CASE WHEN {_special(SCIENCE, SCIENCE.generic)} AND n < 2 AND NOT extracted THEN least(wa, 0.34) ELSE wa END AS wb FROM w2), w4 AS (SELECT *, CASE WHEN {' OR '.join('(' + _special(s, s.core) + ')' for s in SPECIAL)} THEN least(1, wb + 0.06) ELSE wb END AS wc FROM w3),
  w5 AS (SELECT *, CASE WHEN ({' OR '.join('(' + _special(s, s.generic) + ')' for s in SPECIAL)}) AND n < 3 AND NOT contains(low_title, term) THEN least(wc, 0.34) ELSE wc END AS wd FROM w4),
  prf AS (SELECT listing_id, term, {S.rnd('wd', 2)} AS weight FROM w5 WHERE {S.rnd('wd', 2)} >= 0.36)"""


def contributions(spark, sf):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    con = lines.select(F.col("l_orderkey").alias("listing_id"), F.col("p_name").alias("term"), (F.lit(0.2) + F.col("l_discount") * 5).alias("weight"), F.lit(1).alias("n"), (F.col("l_returnflag") == "R").alias("extracted"))
    return con, orders.select(F.col("o_orderkey").alias("listing_id"), F.col("o_orderpriority").alias("title"))


@query("E12_requirement_profile", f"WITH {PROFILE_SQL} SELECT listing_id, term, weight FROM prf")
def e12(spark, sf):
    con, listings = contributions(spark, sf)
    return Q.requirement_profile(con, listings, "listing_id", "title", SPECIAL, SCIENCE)


@query(
    "E12_assemble_profile",
    f"""WITH {PROFILE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY weight DESC, term) AS pos FROM prf)
    SELECT listing_id, string_agg(term, '|' ORDER BY pos) AS terms, {S.rnd('CAST(sum(CAST(round(weight * 100) AS BIGINT)) FILTER (pos <= 6) AS DOUBLE) / (count(*) FILTER (pos <= 6))', 1)} AS quality FROM r GROUP BY listing_id""",
)
def e12_assembled(spark, sf):
    con, listings = contributions(spark, sf)
    out = Q.assemble_profile(Q.requirement_profile(con, listings, "listing_id", "title", SPECIAL, SCIENCE), "listing_id")
    return out.select("listing_id", F.array_join("terms", "|").alias("terms"), "quality")


KEEP = (("1-URGENT", "red ring"), ("1-URGENT", "blue bolt"), ("2-HIGH", "no such term"), ("3-MEDIUM", "hot gear"))
ADD = (("1-URGENT", "cold plate"), ("5-LOW", "new anvil"), ("3-MEDIUM", "zinc"))


@query(
    "E14_ground_terms",
    f"""WITH c AS (SELECT DISTINCT o_orderpriority AS q, l_orderkey AS listing_id, p_name AS term FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'),
    ev AS (SELECT DISTINCT l_orderkey AS listing_id, p_name AS term FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'),
    w AS (SELECT l_orderkey AS listing_id, p_name AS term, max(l_discount) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber > 2 GROUP BY ALL),
    k AS (SELECT k.* FROM {S.values(['q', 'term'], KEEP)} k WHERE EXISTS (SELECT 1 FROM c WHERE c.q = k.q AND c.term = k.term)),
    kept AS (SELECT c.listing_id, c.term FROM c JOIN k USING (q, term) UNION SELECT listing_id, term FROM c WHERE q NOT IN (SELECT q FROM k)),
    added AS (SELECT DISTINCT c.listing_id, a.term FROM c JOIN {S.values(['q', 'term'], ADD)} a USING (q) JOIN ev ON ev.listing_id = c.listing_id AND ev.term = a.term),
    b AS (SELECT * FROM kept UNION SELECT * FROM added)
    SELECT b.listing_id, b.term, coalesce(weight, CASE WHEN b.listing_id % 5 = 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.82 AS DOUBLE) END) AS weight FROM b LEFT JOIN w USING (listing_id, term)""",
)
def e14(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    named = lines.select(F.col("o_orderpriority").alias("query_id"), F.col("l_orderkey").alias("listing_id"), F.col("p_name").alias("term"), "l_returnflag", "l_linenumber", "l_discount")
    cand = named.filter("l_returnflag <> 'N'").select("query_id", "listing_id", "term").distinct()
    weights = named.filter("l_linenumber > 2").groupBy("listing_id", "term").agg(F.max("l_discount").alias("weight"))
    base = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("listing_id"))
    return Q.ground_terms(
        cand, weights, values_frame(spark, ["query_id", "term"], KEEP), values_frame(spark, ["query_id", "term"], ADD), named.filter("l_returnflag = 'N'").select("listing_id", "term"), base
    )


@query(
    "E15_title_fallback_profile",
    f"""WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL}, {MODEL_SQL}, t AS (SELECT p_partkey, p.label, baseline_terms[1:5] AS b FROM parts p JOIN mdl2 USING (label) JOIN hints h USING (label) WHERE p_partkey % 3 <> 0 AND (normalized <> expanded OR domain IS NOT NULL)),
    u AS (SELECT p_partkey, unnest(b) AS term, unnest(range(1, len(b) + 1)) AS pos FROM t)
    SELECT p_partkey, term, CAST(0.36 AS DOUBLE) AS weight, pos, CAST(36 AS DOUBLE) AS quality, 'title-variant-inferred' AS mode FROM u""",
)
def e15(spark, sf):
    hints = hints_frame(spark, sf)
    models = R.role_term_model(hints, ROLES).join(hints.select("label", ((F.col("normalized") != F.col("expanded")) | F.col("domain").isNotNull()).alias("recognised")), ["label"])
    parts = parts_frame(spark, sf)
    return Q.title_fallback_profile(parts, parts.filter("p_partkey % 3 = 0"), models, "p_partkey", "label")
