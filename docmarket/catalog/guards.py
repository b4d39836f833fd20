"""Guards and selection on order lines whose numbers stand in for the scores of a candidate row."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.functions import text as T
from docmarket.operators import guards as H, select as J
from docmarket.operators.ranking import top_per_group
from docmarket.registry import query
from docmarket.session import small_methods
from docmarket.sources.tables import table

# Integer arithmetic over the line's keys, readable by both engines.
_M = "(l_orderkey * {m} + l_partkey * 7 + l_linenumber * 3)"
_NUM = {  # column -> (multiplier, modulus, offset, divisor)
    "alignment": (31, 7, -3, 1), "precision": (37, 4, 0, 1), "title_overlap": (41, 3, 0, 1), "family_overlap": (43, 4, 0, 1), "core_title": (47, 4, 0, 1), "core_text": (53, 4, 0, 1),
    "specialty_overlap": (59, 3, 0, 1), "domain_score": (61, 4, 0, 1), "skill_overlap": (67, 20, 0, 2), "role_fit": (71, 40, 0, 4), "market_quality": (73, 110, 0, 1), "listing_quality": (79, 40, 0, 2),
    "requirement_quality": (83, 60, 0, 1), "title_alignment": (89, 40, -10, 1), "location_score": (97, 11, 0, 10), "skill_count": (101, 8, 0, 1), "hint_overlap": (103, 4, 0, 1),
    "primary_overlap": (107, 3, 0, 1), "title_hint_hits": (109, 3, 0, 1), "primary_hits": (113, 4, 0, 1), "market_hits": (127, 6, 0, 1), "n_raw_tokens": (131, 4, 0, 1), "raw_title_hits": (137, 3, 0, 1),
    "raw_hits": (139, 2, 0, 1), "penalty": (149, 3, 0, 1), "focused_location": (151, 3, 0, 2),
}
_BOOL = {  # column -> (multiplier, modulus): true when the remainder is 0
    "strict": (157, 2), "needs_specialty": (163, 4), "has_specialty": (167, 2), "business": (173, 5), "sparse": (179, 7), "abstract_role": (181, 3), "negative_hit": (191, 6), "finance_mismatch": (193, 9),
    "web_mismatch": (197, 8), "head_overlap": (199, 2), "hard_mismatch": (211, 7), "leadership_clash": (223, 6), "excluded_title": (227, 9), "security_title": (229, 2), "weak_software": (233, 3),
    "family_title_bad": (239, 8), "other_known_role": (241, 3), "has_market": (251, 2), "has_primary": (257, 2), "raw_phrase_hit": (263, 4), "multi_word_hint": (269, 5),
}
SIG = {n: f"CAST({_M.format(m=m)} % {k} + {o} AS {'DOUBLE' if d > 1 or n in ('market_quality', 'requirement_quality', 'title_alignment') else 'INT'}){f' / {d}' if d > 1 else ''}" for n, (m, k, o, d) in _NUM.items()}
SIG |= {n: f"{_M.format(m=m)} % {k} = 0" for n, (m, k) in _BOOL.items()}
DOMAINS, FEEDS = ("data", "software", "security", "product", "design"), ("themuse", "jobicy", "remotive", "remoteok", "adzuna", "greenhouse")
KEY = "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"
_case = lambda vals, expr: "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals)) + " END"
SIG |= {"q_domain": _case(DOMAINS, "l_suppkey % 6"), "source": _case(FEEDS, "l_partkey % 6"), "query_id": "l_suppkey", "key": KEY, "company": "l_partkey % 50", "title_key": "l_partkey % 9", "signature": "l_orderkey % 701"}
COLS = ", ".join(f"{e} AS {n}" for n, e in SIG.items())
CAND_SQL = f"cand AS (SELECT *, NOT family_title_bad AS family_title_ok FROM (SELECT {COLS} FROM lineitem))"


def cand(spark, sf):
    small_methods(spark)
    rows = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in SIG.items()])
    return H.with_guard_columns(rows.withColumn("family_title_ok", ~F.col("family_title_bad")))


DATA, SOFT, SEC = "coalesce(q_domain = 'data', false)", "coalesce(q_domain = 'software', false)", "coalesce(q_domain = 'security', false)"
LACK = "(needs_specialty AND specialty_overlap = 0)"
EXPL = f"(NOT negative_hit AND NOT {LACK} AND alignment >= 0 AND (title_overlap >= 1 OR (family_overlap >= 2 AND core_title >= 1) OR precision >= 1 OR core_text >= 2))"
BUS = f"(title_overlap >= 1 OR precision >= 1 OR {EXPL} OR (domain_score >= 2 AND (core_title >= 1 OR family_overlap >= 1)))"
BRIDGE = f"""CASE WHEN alignment < 1 OR web_mismatch OR {LACK} OR role_fit < 1.5 THEN false WHEN precision >= 1 OR title_overlap >= 1 THEN true WHEN has_specialty AND specialty_overlap >= 1 AND NOT head_overlap AND precision <= 0 THEN false
  WHEN {DATA} AND strict THEN core_title >= 1 AND (specialty_overlap >= 1 OR family_overlap >= 1 OR domain_score >= 2 OR role_fit >= 3) WHEN alignment >= 3 AND head_overlap AND domain_score >= 2 THEN true
  WHEN specialty_overlap >= 1 AND (head_overlap OR family_overlap >= 1) AND domain_score >= 2 THEN true WHEN alignment = 1 AND head_overlap AND (family_overlap >= 1 OR domain_score >= 2) THEN core_title >= 1 OR role_fit >= 2
  WHEN abstract_role AND domain_score >= 2 THEN family_overlap >= 1 OR role_fit >= 2.5 ELSE false END"""
RECOV = f"({SEC} AND security_title AND NOT (alignment < 0 AND title_overlap = 0 AND domain_score < 2) AND domain_score >= 2 AND (title_overlap >= 1 OR role_fit >= 3 OR market_quality >= 90))"
TIED = "(family_overlap >= 1 OR core_title >= 1 OR domain_score >= 2 OR head_overlap)"
HITS = "(title_hint_hits + 2 * primary_hits + least(market_hits, 4))"
CTX = f"""CASE WHEN {LACK} OR q_domain IS NULL THEN false WHEN precision >= 1 OR title_overlap >= 1 THEN true WHEN alignment < 0 AND core_title < 2 THEN false
  WHEN q_domain = 'data' THEN CASE WHEN title_overlap = 0 AND core_title = 0 THEN (market_hits >= 5 OR skill_overlap >= 8) AND role_fit >= 2 AND (family_overlap >= 1 OR domain_score >= 2 OR head_overlap)
    ELSE (primary_hits >= 3 OR market_hits >= 4 OR skill_overlap >= 5) AND role_fit >= 2 AND {TIED} END
  WHEN q_domain IN ('software', 'security', 'infra') THEN {HITS} >= 3 AND role_fit >= 1.75 AND {TIED} ELSE {HITS} >= 3 AND role_fit >= 2 AND {TIED} END"""
FLAGS_SQL = f"{CAND_SQL}, fl AS (SELECT *, {LACK} AS lack, {EXPL} AS expl, {BUS} AS bus, {BRIDGE} AS bridge, {RECOV} AS recov, {CTX} AS ctx, precision <= 0 AND title_overlap = 0 AS untitled FROM cand)"
FINAL = f"""CASE WHEN alignment <= -3 OR lack OR finance_mismatch THEN false WHEN bridge OR recov THEN true WHEN family_title_bad THEN false WHEN strict AND (leadership_clash OR excluded_title) THEN false
  WHEN ({SOFT} OR {SEC}) AND untitled AND family_overlap = 0 AND NOT ({SOFT} AND weak_software AND alignment >= 1 AND specialty_overlap >= 1 AND role_fit >= 3 AND ctx) THEN false
  WHEN strict AND untitled AND core_title = 0 AND NOT ctx THEN false WHEN strict AND alignment = 1 AND untitled AND NOT ctx THEN false
  WHEN {DATA} AND untitled AND family_overlap = 0 AND core_title = 0 AND NOT ctx AND role_fit < 3.5 THEN false WHEN {DATA} AND alignment < 0 AND untitled THEN false WHEN role_fit < 1 AND precision <= 0 AND core_title = 0 THEN false ELSE true END"""
GATE = f"""CASE WHEN hard_mismatch OR negative_hit OR (alignment < 0 AND title_overlap = 0 AND core_title = 0) OR title_alignment <= -6 THEN false WHEN business AND bus THEN requirement_quality >= 8 OR listing_quality >= 4 OR role_fit >= 0.3
  WHEN sparse AND ((skill_overlap < 1 AND precision < 2) OR (requirement_quality < 18 AND role_fit < 2.5)) THEN false WHEN source IN ('remotive', 'remoteok', 'arbeitnow') AND role_fit >= 5 AND expl THEN true
  WHEN NOT expl AND title_overlap + family_overlap + domain_score = 0 THEN false WHEN precision <= 0 AND domain_score < 2 THEN false WHEN listing_quality < 4.5 AND NOT expl THEN false WHEN role_fit < 2 THEN false
  WHEN other_known_role AND role_fit < 4.5 THEN false WHEN has_market AND hint_overlap = 0 AND role_fit < 6.5 THEN false WHEN has_market AND hint_overlap = 1 AND skill_count <= 2 THEN false
  WHEN has_primary AND primary_overlap = 0 AND role_fit < 9 THEN false WHEN title_overlap = 0 AND core_title = 0 AND family_overlap = 0 AND domain_score < 2 AND skill_overlap < 1.5 THEN false
  ELSE requirement_quality >= 22 OR listing_quality >= 8 OR skill_count >= 3 OR role_fit >= 4.5 END"""
REJECT = "hard_mismatch OR lack OR finance_mismatch OR (alignment < 0 AND title_overlap = 0 AND core_title = 0) OR (alignment < 0 AND precision <= 0 AND title_overlap = 0) OR title_alignment <= -6"
LOST = f"({DATA} AND NOT expl AND precision <= 0 AND title_overlap = 0 AND core_title = 0 AND family_overlap = 0 AND role_fit < 3.25) OR (({SOFT} OR {SEC}) AND precision <= 0 AND title_overlap = 0 AND family_overlap = 0)"
STRONG = f"""CASE WHEN {REJECT} THEN false WHEN business AND alignment >= 0 AND bus AND location_score > 0 THEN market_quality >= 10 OR role_fit >= 0.4 OR title_alignment >= 8 WHEN {LOST} THEN false
  WHEN sparse THEN NOT (precision <= 0 AND title_overlap = 0 AND family_overlap = 0) AND ((skill_overlap >= 1 AND (precision >= 1 OR family_overlap >= 1 OR expl)) OR (title_overlap >= 1 AND market_quality >= 36 AND role_fit >= 1))
  WHEN location_score < 0.2 OR (NOT expl AND market_quality < 48) OR (precision <= 0 AND domain_score < 2 AND NOT expl) THEN false
  ELSE (source IN ('themuse', 'jobicy') AND domain_score >= 2 AND (title_overlap >= 1 OR family_overlap >= 1 OR (skill_overlap >= 1.5 AND core_title >= 1))) OR (core_title >= 1 AND skill_overlap >= 1)
    OR (source IN ('themuse', 'jobicy') AND (title_overlap >= 1 OR family_overlap >= 2) AND market_quality >= 18) OR (title_overlap >= 1 AND role_fit >= 1) OR (title_overlap >= 1 AND skill_overlap >= 1)
    OR (domain_score >= 2 AND skill_overlap >= 1.5 AND (precision >= 1 OR title_overlap >= 1 OR family_overlap >= 1 OR core_title >= 1)) OR (family_overlap >= 2 AND role_fit >= 3 AND skill_overlap >= 1)
    OR (title_overlap >= 2 AND (role_fit >= 1.6 OR skill_overlap >= 1)) OR (title_overlap = 0 AND role_fit >= 6 AND skill_overlap >= 2 AND market_quality >= 40) OR (source IN ('remotive', 'remoteok', 'arbeitnow') AND title_overlap >= 1 AND market_quality >= 28) END"""
LOOSE = f"""CASE WHEN {REJECT} THEN false WHEN business AND alignment >= 0 AND bus AND location_score > 0 THEN market_quality >= 8 OR role_fit >= 0.2 OR title_alignment >= 5 WHEN {LOST} THEN false
  WHEN sparse THEN NOT (precision <= 0 AND title_overlap = 0 AND family_overlap = 0) AND ((skill_overlap >= 1 AND domain_score >= 1 AND (precision >= 1 OR family_overlap >= 1)) OR (title_overlap >= 1 AND market_quality >= 30 AND role_fit >= 1))
  WHEN location_score <= 0 OR (NOT expl AND market_quality < 40) OR (precision <= 0 AND domain_score < 2 AND NOT expl) THEN false
  ELSE (source IN ('themuse', 'jobicy') AND domain_score >= 2) OR (core_title >= 1 AND (skill_overlap >= 1 OR role_fit >= 2)) OR (source IN ('themuse', 'jobicy') AND (title_overlap >= 1 OR family_overlap >= 2)) OR (title_overlap >= 1 AND role_fit >= 0.5)
    OR (domain_score >= 2 AND (skill_overlap >= 1 OR role_fit >= 1.5)) OR (family_overlap >= 2 AND role_fit >= 2.5) OR (title_overlap = 0 AND skill_overlap >= 2 AND role_fit >= 3.25) OR (market_quality >= 42 AND title_overlap >= 1) END"""
FAMILY = f"""CASE WHEN hard_mismatch OR lack THEN false WHEN bridge THEN true WHEN alignment < 0 AND title_overlap = 0 THEN false WHEN business AND (title_overlap >= 1 OR precision >= 1 OR (domain_score >= 2 AND (core_title >= 1 OR family_overlap >= 1))) THEN true
  WHEN {DATA} AND title_overlap = 0 AND family_overlap = 0 AND precision <= 0 AND core_title = 0 AND role_fit < 3.25 THEN false
  ELSE (domain_score >= 2 AND skill_overlap >= 1 AND (precision >= 1 OR title_overlap >= 1 OR family_overlap >= 1 OR core_title >= 1)) OR (domain_score >= 1 AND title_overlap >= 1) OR (domain_score >= 1 AND family_overlap >= 2 AND role_fit >= 2)
    OR (domain_score >= 1 AND market_quality >= 28 AND skill_overlap >= 1 AND precision >= 1) END"""
BACKUP = f"""CASE WHEN hard_mismatch OR finance_mismatch THEN false WHEN bridge OR recov THEN true WHEN alignment < 0 THEN false WHEN strict AND alignment = 1 AND untitled AND NOT ctx THEN false WHEN lack THEN false WHEN title_overlap >= 1 OR precision >= 1 THEN true
  WHEN {DATA} THEN ctx OR (core_title >= 1 AND (domain_score >= 2 OR skill_overlap >= 1 OR role_fit >= 3)) WHEN {SOFT} OR {SEC} THEN core_title >= 1 AND (domain_score >= 2 OR role_fit >= 3 OR family_overlap >= 1) ELSE ({LOOSE}) END"""
SAME = f"""CASE WHEN hard_mismatch OR NOT ({FINAL}) OR lack THEN false WHEN bridge THEN true
  WHEN {DATA} THEN CASE WHEN strict AND alignment = 1 AND untitled THEN ctx WHEN NOT untitled THEN true WHEN ctx THEN true ELSE alignment >= 0 AND core_title >= 1 AND (family_overlap >= 1 OR domain_score >= 2 OR skill_overlap >= 1 OR role_fit >= 2.5) END
  WHEN alignment >= 1 AND core_title >= 1 THEN true WHEN NOT untitled THEN true WHEN {SOFT} OR {SEC} THEN core_title >= 1 AND (family_overlap >= 1 OR skill_overlap >= 1 OR role_fit >= 2.5) ELSE ({FAMILY}) END"""
PRECISE = """CASE WHEN n_raw_tokens = 0 THEN true WHEN lack OR web_mismatch THEN false WHEN strict THEN raw_phrase_hit OR multi_word_hint OR (n_raw_tokens >= 2 AND raw_title_hits >= 2) OR (precision >= 2 AND (core_title >= 2 OR family_overlap >= 2))
  ELSE raw_phrase_hit OR raw_hits >= 1 OR title_overlap >= 1 OR precision >= 2 OR (skill_overlap >= 1.5 AND domain_score >= 2) END"""
CACHE = "alignment >= 0 AND (precision >= 2 OR title_overlap >= 1 OR (family_overlap >= 2 AND core_title >= 1) OR (domain_score >= 2 AND skill_overlap >= 1.5))"


def _guard(name, sql, column):
    @query(name, f"WITH {FLAGS_SQL} SELECT key FROM fl WHERE {sql}")
    def run(spark, sf):
        return cand(spark, sf).filter(column()).select("key")

    return run


_guard("H1_quality_gate", GATE, H.quality_gate)
_guard("H3_explicit_alignment", "expl", H.explicit_alignment)
_guard("H4_final_guard", FINAL, H.final_guard)
_guard("H5_precise_query_guard", PRECISE, H.precise_query_guard)
_guard("H6_exact_backup_guard", BACKUP, H.exact_backup_guard)
_guard("H7_same_family_recovery_guard", SAME, H.same_family_recovery_guard)
_guard("H8_contextual_recovery_guard", "ctx", H.contextual_recovery)
_guard("H9_family_bridge_guard", "bridge", H.family_bridge)
_guard("H10_domain_recovery_guard", "recov", H.domain_recovery)
_guard("H12_strong_candidate", STRONG, lambda: H.live_candidate(True))
_guard("H12_secondary_candidate", LOOSE, lambda: H.live_candidate(False))
_guard("H13_family_candidate", FAMILY, H.family_candidate)
_guard("H14_cache_safe_match", CACHE, H.cache_safe_match)


@query(
    "H2_relevant_or_relaxed",
    f"""WITH {FLAGS_SQL}, g AS (SELECT key, key // 1000000 AS query_id, role_fit, hard_mismatch, location_score, market_quality, ({GATE}) AS ok FROM fl),
    r AS (SELECT key, row_number() OVER (PARTITION BY query_id ORDER BY location_score DESC, market_quality DESC, key) AS rn FROM g WHERE query_id NOT IN (SELECT query_id FROM g WHERE ok) AND role_fit >= 6 AND NOT hard_mismatch)
    SELECT key FROM g WHERE ok UNION ALL SELECT key FROM r WHERE rn <= 5""",
)
def h2(spark, sf):
    rows = cand(spark, sf).withColumn("query_id", F.floor(F.col("key") / 1000000))
    return H.relevant_or_relaxed(rows, H.quality_gate(), "key").select("key")


TITLE_WORDS = ("finance", "tax analyst", "budget analyst", "treasury lead", "ios", "android web", "react", "security engineer", "sales security lead", "soc analyst", "payroll")
TITLE_SQL = f"t AS (SELECT p_partkey, p_name || ' ' || ({S.str_list(TITLE_WORDS)})[CAST(p_partkey % {len(TITLE_WORDS)} AS BIGINT) + 1] AS title FROM part)"


@query(
    "H11_title_mismatch_guard",
    f"""WITH {TITLE_SQL} SELECT p_partkey, (regexp_matches(title, {S.q(H.FINANCE_OTHERS)}) OR (regexp_matches(title, {S.q(H.FINANCE_WORDS)}) AND NOT regexp_matches(title, '\\banalyst\\b'))) AND NOT regexp_matches(title, {S.q(r'\b(' + '|'.join(H.FINANCE_ANALYSTS) + r')\b')}) AS finance,
      regexp_matches(title, 'ios|android|mobile|swift|kotlin|flutter') AND NOT regexp_matches(title, 'react|frontend|web|javascript|typescript|ui') AS web,
      NOT regexp_matches(title, {S.q(H.SECURITY_BLOCKED)}) AND regexp_matches(title, {S.q(H.SECURITY_ROLES)}) AND regexp_matches(title, {S.q(r'\b(' + '|'.join(H.SECURITY_SIGNS) + r')\b')}) AS security FROM t""",
)
def h11(spark, sf):
    word = F.element_at(T.lit_array(TITLE_WORDS), (F.col("p_partkey") % len(TITLE_WORDS) + 1).cast("int"))
    title = F.concat("p_name", F.lit(" "), word)
    return table(spark, sf, "part").select(
        "p_partkey", H.finance_mismatch(title, F.lit("financial analyst")).alias("finance"), H.web_mismatch(title, F.lit("frontend developer")).alias("web"), H.security_title(title).alias("security")
    )


@query(
    "H15_positively_aligned_or_all",
    f"""WITH {CAND_SQL}, g AS (SELECT key, key // 10000000 AS query_id, title_alignment FROM cand), n AS (SELECT query_id FROM g GROUP BY 1 HAVING count(*) FILTER (title_alignment > 0) >= 5)
    SELECT key FROM g WHERE title_alignment > 0 OR query_id NOT IN (SELECT query_id FROM n)""",
)
def h15(spark, sf):
    rows = cand(spark, sf).withColumn("query_id", F.floor(F.col("key") / 10000000))
    return H.positively_aligned_or_all(rows, "title_alignment", 5).select("key")


# --- ranking and selection ---------------------------------------------------------

RANK_SQL = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY " + ", ".join(f"{k[1:]} ASC" if k.startswith("-") else f"{k} DESC" for k in J.RANK_KEYS) + ", key) AS rank FROM cand)"


@query("J1_rank_candidates", f"WITH {CAND_SQL}, {RANK_SQL} SELECT query_id, key, rank FROM ranked")
def j1(spark, sf):
    return J.rank_candidates(cand(spark, sf), "key").select("query_id", "key", "rank")


@query("J1_rank_in_ranges", f"WITH {CAND_SQL}, {RANK_SQL} SELECT query_id, key, rank FROM ranked")
def j1_ranges(spark, sf):
    """The same ranks with every query cut into ranges of about a thousand rows."""
    return J.rank_candidates(cand(spark, sf), "key", rows_per_range=1000).select("query_id", "key", "rank")


def wave_flags(df):
    safe = ~F.col("hard_mismatch") & F.col("g_final")
    t = (F.col("title_overlap") >= 1) | (F.col("precision") >= 2) | (F.col("family_overlap") >= 2)
    flags = {
        "is_strong": H.live_candidate(True), "is_secondary": H.live_candidate(False), "is_family": H.family_candidate(), "is_recovery": F.col("g_recovery"),
        "is_related": (F.col("alignment") >= 0) & t, "is_last_resort": (F.col("source") == "jobicy") & (F.col("alignment") >= 0) & (F.col("market_quality") >= 18),
    }
    df = df.withColumns({n: c & safe for n, c in flags.items()})
    exact = (F.col("alignment") >= 2) & (F.col("precision") >= 2)
    return df.withColumns(
        {
            "source_cap": J.source_cap(F.col("source"), F.lit(12), F.lit(6), F.lit(20)), "title_cap_low": F.when(F.col("source").isin("jobicy", "themuse"), 3).when(exact, 2).otherwise(1),
            "title_cap": F.lit(1), "similar_ok_low": exact, "similar_ok": exact,
        }
    )


@query("J2_select_diverse")
def j2(spark, sf):
    ranked = wave_flags(J.rank_candidates(cand(spark, sf), "key"))
    queries = ranked.select("query_id").distinct().withColumns({"live_target": F.lit(12), "display_floor": F.lit(10)})
    return J.select_diverse(ranked, queries)


@query(
    "J2_cap_per_company",
    f"""WITH {CAND_SQL}, {RANK_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, company ORDER BY rank) AS k FROM ranked)
    SELECT query_id, key, position FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM c WHERE k <= 2) WHERE position <= 15""",
)
def j2_cap(spark, sf):
    return J.cap_per_company(cand(spark, sf), 2, 15, J.rank_order("key")).select("query_id", "key", "position")


@query(
    "J3_source_cap",
    """SELECT o_orderkey, greatest(CASE o_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 3 END, least(10 + o_custkey % 5, CAST(ceil(CAST(4 + o_orderkey % 12 AS DOUBLE) / (1 + o_orderkey % 7)) AS BIGINT) + 1)) AS cap FROM orders""",
)
def j3(spark, sf):
    source = F.element_at(T.lit_array(("remoteok", "Arbeitnow", "lever", "jooble", "jobicy", "other")), (F.col("o_custkey") % 6 + 1).cast("int"))
    cap = J.source_cap(source, F.col("o_orderkey") % 12 + 4, F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 5 + 10)
    return table(spark, sf, "orders").select("o_orderkey", cap.alias("cap"))


@query(
    "J4_fill_to_floor",
    """WITH s AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT l_orderkey AS query_id, l_partkey AS key, min(l_linenumber) AS t FROM lineitem GROUP BY ALL),
    n AS (SELECT o_orderkey AS query_id, (SELECT count(*) FROM s WHERE s.query_id = o_orderkey) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_safe FROM orders),
    m AS (SELECT query_id, 3 - n AS missing FROM n WHERE n < 3 AND n_safe >= 3),
    a AS (SELECT f.query_id, f.key, missing, row_number() OVER (PARTITION BY f.query_id ORDER BY t * 100000000 + f.key) AS k FROM f JOIN m USING (query_id) ANTI JOIN s USING (query_id, key))
    SELECT query_id, key, false AS filled FROM s UNION ALL SELECT query_id, key, true FROM a WHERE k <= missing""",
)
def j4(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("key"), "l_returnflag", (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("t"))
    floors = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(3).alias("floor"))
    return J.fill_to_floor(lines.filter("l_returnflag = 'R'").select("query_id", "key").distinct(), lines.drop("l_returnflag"), floors, "t")


@query(
    "J5_top_matches_reserved",
    f"""WITH t AS (SELECT l_suppkey AS query_id, {KEY} AS key, CASE WHEN l_partkey % 10 = 0 THEN 'role-baseline' ELSE 'feed' END AS source, l_extendedprice AS relevance FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source <> 'role-baseline' DESC, relevance DESC, key) AS position, count(*) FILTER (source <> 'role-baseline') OVER (PARTITION BY query_id) AS n_live FROM t),
    b AS (SELECT query_id, key FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, key) AS k FROM t WHERE source = 'role-baseline') WHERE k = 1)
    SELECT query_id, key, position FROM r WHERE position <= 20 AND NOT (n_live >= 20 AND position = 20 AND query_id IN (SELECT query_id FROM b)) UNION ALL SELECT query_id, key, 20 FROM b WHERE query_id IN (SELECT query_id FROM r WHERE n_live >= 20)""",
)
def j5(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_suppkey AS query_id", f"{KEY} AS key", "CASE WHEN l_partkey % 10 = 0 THEN 'role-baseline' ELSE 'feed' END AS source", "l_extendedprice AS relevance")
    return J.top_matches_reserved(rows, "key").select("query_id", "key", "position")


@query(
    "J6_best_stage",
    f"""WITH t AS (SELECT o_custkey AS query_id, o_orderpriority AS stage, CAST(o_orderpriority[1] AS INTEGER) AS stage_no, count(*) AS n, count(DISTINCT o_orderstatus) AS n_sources, {S.rnd('sum(o_totalprice)', 4)} AS signal FROM orders GROUP BY ALL)
    SELECT query_id, stage, n, n_sources, signal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, n_sources DESC, signal DESC, stage_no) AS rn FROM t) WHERE rn = 1""",
)
def j6(spark, sf):
    stages = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("stage"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage_no"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("signal")
    )
    return J.best_stage(stages)


@query(
    "J7_weakest_components",
    """WITH t AS (SELECT o_orderkey, unnest([o_orderkey * 31 % 100, o_orderkey * 37 % 100, o_orderkey * 41 % 100, o_orderkey * 43 % 100, o_orderkey * 47 % 100, o_orderkey * 53 % 100]) AS score, unnest([0, 1, 2, 3, 4, 5]) AS no,
      unnest(['skill_match', 'semantic_match', 'experience_match', 'market_demand', 'resume_quality', 'ats_compliance']) AS component FROM orders)
    SELECT o_orderkey, position, component, score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score, no) AS position FROM t) WHERE position <= 3""",
)
def j7(spark, sf):
    names = {"skill_match": 31, "semantic_match": 37, "experience_match": 41, "market_demand": 43, "resume_quality": 47, "ats_compliance": 53}
    runs = table(spark, sf, "orders").select("o_orderkey", *[(F.col("o_orderkey") * m % 100).alias(n) for n, m in names.items()])
    return J.weakest_components(runs, "o_orderkey", list(names), 3)


@query(
    "J8_nearest_location_pool",
    f"WITH t AS (SELECT l_orderkey AS query_id, {KEY} AS key, CASE WHEN l_quantity > 45 THEN 1 WHEN l_quantity > 35 THEN 2 ELSE 3 END AS tier FROM lineitem) SELECT query_id, key FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.query_id = t.query_id)",
)
def j8(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", f"{KEY} AS key", "l_quantity")
    tier = F.when(F.col("l_quantity") > 45, 1).when(F.col("l_quantity") > 35, 2).otherwise(3)
    return J.nearest_location_pool(rows, tier).select("query_id", "key")


@query(
    "J9_cap_per_group",
    f"""WITH {CAND_SQL}, {RANK_SQL}, c AS (SELECT query_id, key, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM ranked WHERE source <> 'adzuna')
    SELECT query_id, key, position FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM c WHERE k <= 4) WHERE position <= 12""",
)
def j9(spark, sf):
    rows = cand(spark, sf).withColumn("source", F.when(F.col("source") != "adzuna", F.col("source")).otherwise(""))
    return J.cap_per_group(rows, "source", 4, 12, J.rank_order("key")).select("query_id", "key", "position")
