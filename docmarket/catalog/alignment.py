"""Listing x query scores on part labels: a part is a listing, the label of the part before it is the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.catalog.roles import FAM_SQL, HINTS_SQL, LEX, MODEL_SQL, NORMAL_SQL, hints_frame, parts_frame
from docmarket.catalog.text import sql_contains_phrase
from docmarket.functions import text as T
from docmarket.operators import alignment as G, taxonomy as R
from docmarket.operators.ranking import top_per_group
from docmarket.registry import query
from docmarket.sources.tables import table

PLACES = ("Pune, India", "Remote", "APAC region", "Berlin, Germany", "Remote - USA", "", "unknown", "Worldwide", "Paris", "united kingdom")
ASKS = ("India", "", "Paris", "Remote", "Bengaluru office")
pick = lambda vals, i: F.element_at(T.lit_array(vals), (i + 1).cast("int"))
psql = lambda vals, i: f"({S.str_list(vals)})[CAST({i} AS BIGINT) + 1]"

CW = S.clean_words
HAS = lambda h, n: f"CASE WHEN {n} = '' THEN false WHEN contains({n}, ' ') THEN contains({h}, {n}) ELSE contains(' ' || {h} || ' ', ' ' || {n} || ' ') END"
CAND_SQL = f"""{NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL},
  gc AS (SELECT a.p_partkey, 'q' || (a.p_partkey % 7) AS query_id, b.label AS q_text, q.role AS q_role, q.role_domain AS q_domain, q.tokens AS q_tokens, q.specialty AS q_specialty, q.title_hints AS q_hints, q.negative_hints AS q_negative,
    q.market_hints AS q_market, q.primary_hints AS q_primary, a.label AS title, t.role AS t_role, t.role_domain AS t_domain, CASE WHEN t.expanded <> t.cleaned THEN t.cleaned || ' ' || t.expanded ELSE t.cleaned END AS t_text,
    CASE WHEN a.p_partkey % 4 = 0 THEN d.label || ', asked for ' || b.label || ' by ' || q.role ELSE d.label || ' ' || a.p_type END AS description, [a.p_type, a.p_brand] AS tags, list_concat(string_split(t.cleaned, ' '), [lower(a.p_type)]) AS terms,
    {psql(PLACES, 'a.p_partkey % 10')} AS location, a.p_partkey % 3 = 0 AS remote, {psql(ASKS, 'a.p_partkey % 5')} AS q_location, {psql(('greenhouse', 'jooble', 'other', 'role-baseline'), 'a.p_partkey % 4')} AS source, CAST(a.p_partkey % 50 AS DOUBLE) AS requirement_quality
    FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey - 1 JOIN parts d ON d.p_partkey = a.p_partkey - 2 JOIN hints t ON t.label = a.label JOIN hints q ON q.label = b.label),
  gx AS (SELECT *, {CW('q_text')} AS cq, {CW('title')} AS ct, {CW('description')} AS cd, {CW('tags[1]')} || ' ' || {CW('tags[2]')} AS cg, list_transform(q_hints, lambda h: {CW('h')}) AS ch, list_transform(q_negative, lambda h: {CW('h')}) AS cn FROM gc)"""


def cand(spark, sf):
    parts = parts_frame(spark, sf)
    key = F.col("p_partkey")
    shift = lambda n, name: parts.select((key + n).alias("p_partkey"), F.col("label").alias(name))
    hints = hints_frame(spark, sf)
    rows = parts.withColumnRenamed("label", "title").join(shift(1, "q_text"), ["p_partkey"]).join(shift(2, "d_label"), ["p_partkey"])
    rows = rows.withColumn("query_id", F.concat(F.lit("q"), key % 7))
    out = G.candidates(rows, rows.select("p_partkey").withColumn("one", F.lit(1)), hints, hints, on=("p_partkey",))
    clean = F.split(T.clean_label(F.col("title")), " ")
    desc = F.when(key % 4 == 0, F.concat("d_label", F.lit(", asked for "), "q_text", F.lit(" by "), "q_role")).otherwise(F.concat_ws(" ", "d_label", "p_type"))
    return out.withColumns(
        {
            "description": desc, "tags": F.array("p_type", "p_brand"), "terms": F.concat(clean, F.array(F.lower("p_type"))), "location": pick(PLACES, key % 10), "remote": key % 3 == 0,
            "q_location": pick(ASKS, key % 5), "source": pick(("greenhouse", "jooble", "other", "role-baseline"), key % 4), "requirement_quality": (key % 50).cast("double"),
        }
    )


ADJ = [f"{a}|{b}" for a, bs in LEX.adjacent.items() for b in bs]
N = lambda l, cond: f"len(list_filter({l}, lambda h: {cond}))"
ALIGN_PARTS = f"""al0 AS (SELECT *, {N('ch', HAS('ct', 'h'))} AS n_t, {N('ch', HAS('cd', 'h') + ' OR ' + HAS('cg', 'h'))} AS n_d, {N('q_tokens', HAS('ct', 'h'))} AS n_c, {N('q_tokens', HAS('cg', 'h'))} AS n_g, {N('cn', HAS('ct', 'h'))} AS n_bad FROM gx),
  al AS (SELECT *, {S.rnd(f'''CASE WHEN q_role = t_role THEN 16 WHEN contains(t_role, q_role) THEN 10.5 ELSE 0 END + CASE WHEN {HAS('ct', 'cq')} THEN 8 WHEN {HAS('cg', 'cq')} THEN 2.5 WHEN {HAS('cd', 'cq')} THEN 1.5 ELSE 0 END + least(10, n_t * 3) + least(4.5, n_d)
    + n_c * 2.5 + n_g + CASE WHEN q_domain IS NULL THEN 0 WHEN t_domain = q_domain THEN 3.5 WHEN t_domain IS NOT NULL THEN -8.5 ELSE 0 END + CASE WHEN n_bad = 0 THEN 0 WHEN n_t = 0 AND n_c = 0 AND NOT contains(t_role, q_role) THEN -12 ELSE -4.5 END''', 2)} AS title_alignment FROM al0)"""


@query("G1_title_alignment", f"WITH RECURSIVE {CAND_SQL}, {ALIGN_PARTS} SELECT p_partkey, title_alignment FROM al")
def g1(spark, sf):
    return cand(spark, sf).select("p_partkey", G.title_alignment().alias("title_alignment"))


FTOK = lambda e: f"list_filter(string_split({CW(e)}, ' '), lambda w: w <> '' AND w NOT IN {S.in_list(G.FAST_STOPWORDS)})"
FAST_SQL = f"""ft AS (SELECT p_partkey, {FTOK('q_text')} AS q, {FTOK('title')} AS t, {FTOK("title || ' ' || tags[1] || ' ' || tags[2] || ' ' || description")} AS x FROM gc),
  fv AS (SELECT p_partkey, list_distinct(q) AS d, array_to_string(q, ' ') AS qs, array_to_string(t, ' ') AS ts, array_to_string(x, ' ') AS xs, t, x FROM ft),
  fast AS (SELECT p_partkey, {S.rnd('CASE WHEN contains(ts, qs) THEN 12 WHEN len(list_intersect(d, t)) = len(d) THEN 9 ELSE least(7, len(list_intersect(d, t)) * 3) END + CASE WHEN contains(xs, qs) AND NOT contains(ts, qs) THEN 2.5 ELSE 0 END + least(4, len(list_intersect(d, x)) * CAST(0.9 AS DOUBLE))', 2)} AS score FROM fv)"""


@query("G2_fast_title_alignment", f"WITH RECURSIVE {CAND_SQL}, {FAST_SQL} SELECT p_partkey, score FROM fast")
def g2(spark, sf):
    return cand(spark, sf).select("p_partkey", G.fast_title_alignment().alias("score"))


RAW = lambda e: f"regexp_replace(lower({e}), '[^a-z0-9+ ]+', ' ', 'g')"
FIT_SQL = f"""f0 AS (SELECT *, {RAW('title')} AS rt, {RAW('description')} AS rd, lower(tags[1]) || ' ' || lower(tags[2]) AS rg FROM gx),
  f1 AS (SELECT *, len(list_filter(q_hints, lambda h: contains(rt, h))) > 0 AS hinted, len(list_filter(q_negative, lambda h: contains(rt, h))) > 0 AS bad FROM f0),
  fit AS (SELECT p_partkey, {S.rnd(f'''(CASE WHEN contains(rt, cq) THEN 4 WHEN contains(rd, cq) THEN 1.75 WHEN contains(rg, cq) THEN 1 ELSE 0 END + CASE WHEN contains(t_role, q_role) THEN 6 ELSE 0 END + CASE WHEN contains(rd, q_role) THEN 3 ELSE 0 END
    + len(list_filter(q_tokens, lambda t: list_contains(string_split(t_role, ' '), t))) * 2 + CASE WHEN hinted THEN 2.5 ELSE 0 END + least(3, len(list_intersect(list_distinct(terms), q_market)) * CAST(0.75 AS DOUBLE)))
    * CASE WHEN NOT bad THEN 1 WHEN hinted THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.12 AS DOUBLE) END * CASE WHEN t_domain <> q_domain THEN CAST(0.18 AS DOUBLE) ELSE 1 END
    * CASE WHEN q_role IN {S.in_list(LEX.families)} AND t_role IN {S.in_list(LEX.families)} AND q_role <> t_role THEN CASE WHEN q_role || '|' || t_role IN {S.in_list(ADJ)} THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END ELSE 1 END''', 2)} AS role_fit FROM f1)"""


@query("G3_role_fit", f"WITH RECURSIVE {CAND_SQL}, {FIT_SQL} SELECT p_partkey, role_fit FROM fit")
def g3(spark, sf):
    return cand(spark, sf).select("p_partkey", G.role_fit(LEX.families, ADJ).alias("role_fit"))


@query("G4_term_overlap", f"WITH RECURSIVE {CAND_SQL} SELECT p_partkey, len(list_intersect(list_distinct(terms), q_primary)) * CAST(1.5 AS DOUBLE) + len(list_intersect(list_distinct(terms), q_market)) AS overlap FROM gc")
def g4(spark, sf):
    return cand(spark, sf).select("p_partkey", G.term_overlap().alias("overlap"))


PHRASE = lambda hay, n: sql_contains_phrase(hay, n)
OVER_SQL = f"""o0 AS (SELECT *, {CW('t_text')} AS tt, {CW("t_text || ' ' || description")} AS td, {CW("t_text || ' ' || description || ' ' || tags[1] || ' ' || tags[2] || ' ' || array_to_string(terms, ' ')")} AS te FROM gx),
  o1 AS (SELECT *, {N('ch', PHRASE('tt', 'h'))} AS title_overlap, len(list_intersect(list_distinct(list_filter(string_split(t_text, ' '), lambda w: length(w) > 2)), list_filter(regexp_split_to_array(q_role, '[^a-z0-9+]+'), lambda w: length(w) > 2 AND w NOT IN ('engineer', 'developer', 'manager')))) AS family_overlap,
    {N('q_tokens', PHRASE('tt', 'h'))} AS core_title, {N('q_tokens', PHRASE('td', 'h'))} AS core_text, {N(f"list_filter(q_specialty, lambda w: w NOT IN {S.in_list(T.ROLE_STOPWORDS + T.ROLE_GENERIC_TOKENS)})", PHRASE('te', 'h'))} AS specialty_overlap FROM o0),
  ov AS (SELECT *, CASE WHEN title_overlap >= 1 THEN title_overlap * 2 WHEN core_title >= 2 THEN core_title + family_overlap WHEN family_overlap >= 2 THEN family_overlap ELSE 0 END AS precision,
    CASE WHEN q_domain IS NULL THEN 0 ELSE CASE WHEN t_domain = q_domain THEN 2 ELSE 0 END + CASE WHEN title_overlap >= 1 THEN 1 ELSE 0 END + CASE WHEN family_overlap >= 1 THEN 1 ELSE 0 END END AS domain_score FROM o1)"""


@query("G5_domain_match", f"WITH RECURSIVE {CAND_SQL}, {OVER_SQL} SELECT p_partkey, domain_score FROM ov")
def g5(spark, sf):
    over = G.title_overlaps()
    return cand(spark, sf).select("p_partkey", G.domain_match(over["title_overlap"], over["family_overlap"]).alias("domain_score"))


@query(
    "G6_title_overlaps",
    f"""WITH RECURSIVE {CAND_SQL}, {OVER_SQL} SELECT p_partkey, title_overlap, family_overlap, core_title, core_text, specialty_overlap, precision,
      CASE WHEN list_has_any(string_split({S.clean_label('q_text')}, ' '), {S.str_list(G.LEADERSHIP)}) THEN 0 ELSE CASE WHEN regexp_matches(t_text, '\\b(manager|director|head|chief|vp|vice president)\\b') THEN 2 ELSE 0 END
      + CASE WHEN contains(t_text, 'architect') AND NOT contains(cq, 'architect') THEN 1 ELSE 0 END END AS penalty FROM ov""",
)
def g6(spark, sf):
    return cand(spark, sf).select("p_partkey", *[v.alias(n) for n, v in G.title_overlaps().items()], G.unrequested_title_penalty().alias("penalty"))


RX = lambda words: "(" + "|".join(words) + ")"
PLACE_SQL = f"""pl AS (SELECT *, {S.clean_label('q_location')} AS want, lower(trim(location)) AS place, {S.clean_label('location')} AS cplace FROM gc),
  pm AS (SELECT *, regexp_matches(place, {S.q(RX(X.COUNTRY_HINTS))}) AS near, regexp_matches(place, {S.q(RX(X.REGION_HINTS))}) AS region, regexp_matches(place, {S.q(RX(X.GLOBAL_HINTS))}) AS world, regexp_matches(place, {S.q(RX(X.OTHER_REGION_HINTS))}) AS other,
    regexp_matches(cplace, {S.q(RX(X.OTHER_REGION_HINTS))}) AS cother, regexp_matches(want, {S.q(RX(X.COUNTRY_HINTS))}) AS focused FROM pl),
  loc AS (SELECT *, CAST(CASE WHEN want IN ('', 'remote', 'worldwide', 'global', 'anywhere') THEN CASE WHEN remote OR world THEN 1 ELSE 0.82 END WHEN contains(place, want) THEN 1
      WHEN want = 'india' THEN CASE WHEN near THEN 1 WHEN region THEN 0.88 WHEN remote AND place = '' THEN 0.84 WHEN world THEN 0.82 WHEN remote AND other THEN 0.72 WHEN other THEN 0.58 WHEN remote THEN 0.66 ELSE 0.52 END
      WHEN remote AND place = '' THEN 0.8 WHEN world THEN 0.78 WHEN remote THEN 0.68 ELSE 0.52 END AS DOUBLE) AS location_score,
    CASE WHEN want IN ('', 'remote', 'worldwide', 'global', 'anywhere') THEN CASE WHEN remote OR world THEN 'global_remote' ELSE 'global_open' END
      WHEN want = 'india' OR focused THEN CASE WHEN near THEN 'exact_country' WHEN region THEN 'near_region' WHEN world THEN 'worldwide_remote' WHEN remote AND place = '' THEN 'remote_unspecified' WHEN remote AND cother THEN 'remote_other_region'
        WHEN cother THEN 'other_region' WHEN remote THEN 'remote_other' WHEN place IN ('', 'unknown') THEN 'unknown' ELSE 'other_location' END
      WHEN contains(cplace, want) THEN 'exact' WHEN remote OR world THEN 'remote_fallback' ELSE 'other_location' END AS location_tier FROM pm)"""


@query("G7_location", f"WITH RECURSIVE {CAND_SQL}, {PLACE_SQL} SELECT p_partkey, location_score, location_tier, focused AND location_tier NOT IN ('exact_country', 'near_region', 'unknown') AS mismatch FROM loc")
def g7(spark, sf):
    args = (F.col("q_location"), F.col("location"), F.col("remote"))
    out = cand(spark, sf).select("p_partkey", "q_location", G.location_score(*args).alias("location_score"), G.location_tier(*args).alias("location_tier"))
    return out.select("p_partkey", "location_score", "location_tier", G.location_mismatch(F.col("q_location"), F.col("location_tier")).alias("mismatch"))


QUAL_SQL = f"""q0 AS (SELECT ov.*, len(list_filter(string_split(cd, ' '), lambda w: w <> '')) AS nw, len(list_distinct(terms)) AS skill_count, regexp_matches(cd, {S.q(RX(X.LOW_SIGNAL_HINTS))}) AS low, len(list_intersect(list_distinct(string_split(ct, ' ')), {S.str_list(X.TITLE_WEAKENERS)})) AS weak FROM ov),
  ql AS (SELECT *, {S.rnd('''greatest(0, least(20, 6 + CASE WHEN nw BETWEEN 90 AND 950 THEN 4 WHEN nw BETWEEN 45 AND 1200 THEN 2 ELSE 0 END + CASE WHEN skill_count >= 6 THEN 4 WHEN skill_count >= 3 THEN 2 ELSE 0 END + CASE WHEN requirement_quality >= 36 THEN 3 WHEN requirement_quality >= 22 THEN 1.5 ELSE 0 END
    + CASE WHEN title_overlap >= 1 THEN 2 ELSE 0 END + CASE WHEN family_overlap >= 1 THEN 1.5 ELSE 0 END + CASE WHEN domain_score >= 2 THEN 2.5 ELSE 0 END - CASE WHEN low THEN 4 ELSE 0 END - CASE WHEN title_overlap = 0 AND family_overlap = 0 THEN least(3, weak * 1.25) ELSE 0 END))''', 2)} AS listing_quality FROM q0)"""


def annotated(spark, sf):
    return G.annotate(cand(spark, sf), LEX.families, ADJ)


@query("G8_listing_quality", f"WITH RECURSIVE {CAND_SQL}, {OVER_SQL}, {QUAL_SQL} SELECT p_partkey, listing_quality FROM ql")
def g8(spark, sf):
    return annotated(spark, sf).select("p_partkey", "listing_quality")


TRUST = "CASE source " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in X.QUALITY_TRUST.items()) + f" ELSE {X.QUALITY_TRUST_OTHER} END"
ANN_SQL = f"""{ALIGN_PARTS}, {FIT_SQL}, {OVER_SQL}, {QUAL_SQL}, {PLACE_SQL},
  an0 AS (SELECT ql.*, al.title_alignment, fit.role_fit, loc.location_score, loc.location_tier, len(list_intersect(list_distinct(ql.terms), ql.q_market)) AS hm, len(list_intersect(list_distinct(ql.terms), ql.q_primary)) AS hp FROM ql JOIN al USING (p_partkey) JOIN fit USING (p_partkey) JOIN loc USING (p_partkey)),
  an AS (SELECT *, {S.rnd(f'(role_fit * 10 + requirement_quality + least(10, skill_count * CAST(1.5 AS DOUBLE)) + hm * 8 + hp * 12 + location_score * 18 + listing_quality * CAST(1.7 AS DOUBLE)) * CAST({TRUST} AS DOUBLE)', 2)} AS market_quality FROM an0)"""


@query("G9_market_quality", f"WITH RECURSIVE {CAND_SQL}, {ANN_SQL} SELECT p_partkey, market_quality FROM an")
def g9(spark, sf):
    return annotated(spark, sf).select("p_partkey", "market_quality")


@query(
    "G10_annotate",
    f"WITH RECURSIVE {CAND_SQL}, {ANN_SQL} SELECT p_partkey, title_alignment, role_fit, location_score, location_tier, domain_score, listing_quality, market_quality, hp * CAST(1.5 AS DOUBLE) + hm AS skill_overlap FROM an",
)
def g10(spark, sf):
    return annotated(spark, sf).select("p_partkey", "title_alignment", "role_fit", "location_score", "location_tier", "domain_score", "listing_quality", "market_quality", "skill_overlap")


@query(
    "G11_context_signals",
    f"""WITH RECURSIVE {CAND_SQL}, {OVER_SQL}, w AS (SELECT *, list_transform(q_primary, lambda h: {CW('h')}) AS cp, list_transform(q_market, lambda h: {CW('h')}) AS cm FROM ov)
    SELECT p_partkey, title_overlap AS title_hint_hits, {N('cp', PHRASE('te', 'h'))} AS primary_hits, {N('cm', PHRASE('te', 'h'))} AS market_hits FROM w""",
)
def g11(spark, sf):
    return cand(spark, sf).select("p_partkey", *[v.alias(n) for n, v in G.context_signals().items()])


@query(
    "G12_cache_bucket",
    f"""WITH RECURSIVE {CAND_SQL} SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'none' WHEN {S.clean_label('title')} = {S.clean_label('q_text')} THEN 'exact' WHEN {S.clean_label('title')} IN ('ring engineer', 'old anvil', 'red ring', 'hot gear') THEN 'related' WHEN t_role = q_role THEN 'canonical' ELSE 'none' END AS bucket FROM gc""",
)
def g12(spark, sf):
    cached = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("title"))
    related = T.lit_array(("ring engineer", "old anvil", "red ring", "hot gear"))
    return cand(spark, sf).select("p_partkey", G.cache_bucket(cached, F.col("q_text"), related, F.col("t_role"), F.col("q_role")).alias("bucket"))


@query(
    "G13_match_strength",
    f"""WITH RECURSIVE {CAND_SQL}, {ANN_SQL}, s AS (SELECT *, hp * 1.5 + hm AS so, list_sort(list_intersect(list_distinct(terms), q_market)) AS rt FROM an)
    SELECT p_partkey, CASE WHEN source = 'role-baseline' THEN CASE p_partkey % 3 WHEN 0 THEN 'Conservative fallback' WHEN 1 THEN 'Guarded baseline' ELSE 'Calibration baseline' END WHEN title_alignment >= 24 OR role_fit >= 12 THEN 'Strong role match'
      WHEN title_alignment >= 12 OR role_fit >= 7 OR so >= 3 THEN 'Related role match' ELSE 'Broad live match' END AS label,
      coalesce(nullif(array_to_string(list_filter([CASE WHEN title_alignment >= 24 THEN 'title matches the role' WHEN title_alignment >= 12 THEN 'title in the same family' END, CASE WHEN len(rt) > 0 THEN 'role terms: ' || array_to_string(rt[1:3], ', ') END,
        CASE WHEN market_quality >= 60 THEN 'detailed requirements' END], lambda x: x IS NOT NULL), '|'), ''), 'kept after title, domain and term checks') AS reasons FROM s""",
)
def g13(spark, sf):
    confidence = pick(("low", "medium", "high"), F.col("p_partkey") % 3)
    rows = annotated(spark, sf).withColumn("role_terms", F.array_sort(F.array_intersect("terms", "q_market")))
    label = G.match_strength(F.col("source"), confidence, F.col("title_alignment"), F.col("role_fit"), F.col("skill_overlap"))
    return rows.select("p_partkey", label.alias("label"), F.array_join(G.match_reasons(F.col("title_alignment"), F.col("market_quality"), F.col("role_terms")), "|").alias("reasons"))


@query("G14_tag_overlap", f"WITH RECURSIVE {CAND_SQL} SELECT p_partkey, len(list_filter(string_split(lower(q_text), ' '), lambda t: length(t) > 2 AND contains(lower(tags[1] || ' ' || tags[2]), t))) * CAST(0.5 AS DOUBLE) AS overlap FROM gc")
def g14(spark, sf):
    return cand(spark, sf).select("p_partkey", G.tag_overlap(F.col("q_text"), F.array("p_type", "p_brand")).alias("overlap"))


@query(
    "J10_rank_per_source",
    f"WITH RECURSIVE {CAND_SQL}, {ANN_SQL} SELECT query_id, source, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY title_alignment DESC, role_fit DESC, location_score DESC, remote DESC, p_partkey) AS rank FROM an) WHERE rank <= 5",
)
def j10(spark, sf):
    return G.rank_per_source(annotated(spark, sf), 5, "p_partkey").select("query_id", "source", "p_partkey", "rank")


@query(
    "E13_fast_profile",
    f"""WITH RECURSIVE {CAND_SQL}, {MODEL_SQL}, {FAST_SQL}, e AS (SELECT gc.p_partkey, t.baseline_terms AS tb, q.baseline_terms AS qb, score FROM gc JOIN mdl2 t ON t.label = gc.title JOIN mdl2 q ON q.label = gc.q_text JOIN fast USING (p_partkey)),
    u AS (SELECT *, list_concat(tb[1:10], list_filter(qb[1:10], lambda x: NOT list_contains(tb, x)))[1:10] AS terms FROM e)
    SELECT p_partkey, coalesce(array_to_string(list_transform(terms, lambda x: x || '=' || CASE WHEN list_contains(tb, x) THEN '0.46' ELSE '0.34' END), '|'), '') AS prior, score AS title_alignment,
      {S.rnd('greatest(0, least(14, score / CAST(2.8 AS DOUBLE)))', 2)} AS role_fit, CAST(CASE WHEN len(terms) = 0 THEN 6 WHEN score > 0 THEN 18 ELSE 10 END AS DOUBLE) AS requirement_quality FROM u""",
)
def e13(spark, sf):
    model = R.role_term_model(hints_frame(spark, sf), LEX).select("label", "baseline_terms")
    rows = cand(spark, sf).join(model.select(F.col("label").alias("title"), F.col("baseline_terms").alias("title_terms")), ["title"]).join(
        model.select(F.col("label").alias("q_text"), F.col("baseline_terms").alias("query_terms")), ["q_text"]
    )
    out = G.fast_profile(rows)
    flat = F.array_join(F.transform("prior", lambda x: F.concat_ws("=", x["term"], x["weight"])), "|")
    return out.select("p_partkey", flat.alias("prior"), "title_alignment", "role_fit", "requirement_quality")
