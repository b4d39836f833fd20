"""Market aggregates on order lines (listing x term), orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.catalog.listings import SIGNATURE_SQL
from docmarket.catalog.terms import LEX_SQL, hits_sql, lexicon
from docmarket.functions import text as T
from docmarket.operators import dedupe as D, market as K, terms as E
from docmarket.registry import query
from docmarket.sources.tables import ROWS_PER_TASK, deal, table, values_frame

FEED_NAMES = ("jobicy", "remotive", "Adzuna", "greenhouse", "role-baseline")
TITLES = ("red ring work", "blue bolt", "hot plate lead", "old rod", "new gizmo shop", "cold anvil")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HINTS = tuple((p, t, k) for p in PRIORITIES for t, k in (("red ring", "primary"), ("blue bolt", "primary"), ("hot plate", "market"), ("cold gear", "market"), ("red ring", "market")))
GENERIC = ("old rod", "new anvil", "small bolt")
KNOWN_TERMS = tuple(f"{a} {b}" for a in ("red", "hot", "old", "blue") for b in ("ring", "bolt", "plate", "rod", "anvil", "widget"))


def pick_sql(values, index):
    return f"({S.str_list(values)})[CAST({index} AS BIGINT) + 1]"


def pick(values, index):
    return F.element_at(T.lit_array(values), (index + 1).cast("int"))


MARKET_SQL = f"""listings AS (SELECT o_orderpriority AS query_id, o_orderkey AS listing_id, {pick_sql(FEED_NAMES, 'o_orderkey % 5')} AS source,
    CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'Co ' || (o_custkey % 40) END AS company, {pick_sql(TITLES, 'o_orderkey % 6')} AS title,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 40000 END AS role_fit, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 25 AS DOUBLE) END AS listing_quality,
    1 + o_orderkey % 3 AS dup_divisor FROM orders),
  terms AS (SELECT o_orderpriority AS query_id, l_orderkey AS listing_id, p_name AS term, max(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / 50 END) AS weight, max(l_linenumber) AS n_evidence
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  hints AS (SELECT query_id, term, bool_or(kind = 'primary') AS is_primary FROM {S.values(['query_id', 'term', 'kind'], HINTS)} GROUP BY ALL)"""


def demand_sql(trust_other: float = X.DEMAND_TRUST_OTHER, generic=GENERIC) -> str:
    """CTEs from listings, terms, hints to ``demand``."""
    trust = "CASE lower(source) " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in X.DEMAND_TRUST.items()) + f" ELSE {trust_other} END"
    return f"""
  pq AS (SELECT query_id, bool_or(source <> 'role-baseline') AS live_present, count(*) FILTER (source <> 'role-baseline') AS live_listings FROM listings GROUP BY query_id),
  jobs AS (SELECT l.query_id, listing_id, lower(source) AS source, source <> 'role-baseline' AS live, live_present, live_listings, lower(title) AS low_title,
    CASE WHEN company = '' THEN lower(source) || ':' || substring(lower(title), 1, 48) ELSE lower(company) END AS company,
    CAST({trust} AS DOUBLE) * CASE WHEN live_present AND source = 'role-baseline' THEN CAST(0.62 AS DOUBLE) ELSE 1 END * (CAST(0.45 AS DOUBLE) + least(coalesce(role_fit, 0), 8) / 8)
      * (CAST(0.65 AS DOUBLE) + least(coalesce(listing_quality, 10), 20) / 28) / dup_divisor AS job_weight FROM listings l JOIN pq USING (query_id)),
  p0 AS (SELECT t.query_id, t.listing_id, t.term, j.* EXCLUDE (query_id, listing_id), n_evidence, coalesce(is_primary, false) AS prim, h.term IS NOT NULL AS hinted,
    coalesce(weight, CASE WHEN live THEN CAST(0.82 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END) AS w0 FROM terms t JOIN jobs j ON t.query_id = j.query_id AND t.listing_id = j.listing_id
    LEFT JOIN hints h ON h.query_id = t.query_id AND h.term = t.term),
  p1 AS (SELECT *, CASE WHEN contains(low_title, term) THEN least(1, w0 + CAST(0.12 AS DOUBLE)) ELSE w0 END AS w1 FROM p0),
  p2 AS (SELECT *, CASE WHEN n_evidence > 1 THEN least(1, w1 + CAST(0.06 AS DOUBLE)) ELSE w1 END AS w2 FROM p1),
  p3 AS (SELECT *, CASE WHEN prim THEN least(1, w2 + CAST(0.08 AS DOUBLE)) WHEN hinted THEN least(1, w2 + CAST(0.03 AS DOUBLE)) ELSE w2 * CAST(0.86 AS DOUBLE) END AS w3 FROM p2),
  p4 AS (SELECT *, job_weight * CASE WHEN term IN {S.in_list(generic)} AND NOT prim THEN w3 * CAST(0.72 AS DOUBLE) ELSE w3 END AS weighted FROM p3),
  tot AS (SELECT query_id, sum(job_weight) AS total FROM jobs WHERE listing_id IN (SELECT listing_id FROM terms) GROUP BY query_id),
  demand AS (SELECT query_id, term, count(*) AS count, count(*) FILTER (live) AS live_count, count(DISTINCT company) AS company_count, count(DISTINCT source) AS source_count,
    {S.rnd('sum(weighted) / max(total) * 100', 1)} AS share, bool_or(prim) AS prim, bool_or(hinted) AS hinted, bool_or(live_present) AS live_present, max(live_listings) AS live_listings
    FROM p4 JOIN tot USING (query_id) GROUP BY query_id, term)"""


def keep_sql(known: str, generic=GENERIC) -> str:
    return f"""NOT (live_present AND live_count = 0 AND (NOT prim OR share < 18)) AND CASE WHEN prim THEN true
      WHEN hinted THEN (live_present AND live_listings >= 6 AND live_count >= 1 AND share >= 7)
        OR NOT ((live_present AND live_count < 2 AND company_count < 2 AND share < 11) OR (term IN {S.in_list(generic)} AND live_count < 2 AND share < 13))
      WHEN {known} THEN (live_present AND live_listings >= 8 AND live_count >= 1 AND share >= 8)
        OR NOT ((live_count < 2 AND company_count < 2 AND share < 13) OR (count < 2 AND company_count < 2))
      ELSE count >= 3 AND company_count >= 2 AND share >= 10 END"""


def named_lines(spark, sf, lines):
    """Order lines with their part and order, and their number; each join gets rows dealt by its key."""
    n, parts = lines.count(), table(spark, sf, "part")
    if parts.count() > ROWS_PER_TASK:  # fewer are broadcast, or met by Spark's own shuffle
        lines, parts = deal(lines, n, "l_partkey"), deal(parts, n, "p_partkey")
    named = lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return deal(named, n, "l_orderkey").join(deal(table(spark, sf, "orders"), n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")), n


def market_rows(spark, sf, *more):
    """Listings, with ``more`` columns of their order; terms of listings, and their number."""
    key, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    listings = orders.select(
        F.col("o_orderpriority").alias("query_id"), key.alias("listing_id"), pick(FEED_NAMES, key % 5).alias("source"),
        F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("Co "), F.col("o_custkey") % 40)).alias("company"), pick(TITLES, key % 6).alias("title"),
        F.when(key % 9 != 0, F.col("o_totalprice") / 40000).alias("role_fit"), F.when(key % 8 != 0, (key % 25).cast("double")).alias("listing_quality"), (key % 3 + 1).alias("dup_divisor"), *more,
    )
    lines, n = named_lines(spark, sf, table(spark, sf, "lineitem"))
    terms = lines.select(
        F.col("o_orderpriority").alias("query_id"), F.col("l_orderkey").alias("listing_id"), F.col("p_name").alias("term"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity") / 50).alias("weight"), F.col("l_linenumber").alias("n_evidence"),
    )
    return listings, terms, n


def by_listing(terms, n):
    """The terms of a listing are looked at together; listings are then joined to them where they are."""
    return deal(terms, n, "query_id", "listing_id")


def market_frames(spark, sf):
    listings, terms, n = market_rows(spark, sf)
    return listings, by_listing(terms, n), values_frame(spark, ["query_id", "term", "kind"], HINTS)


def demand_frame(spark, sf):
    return K.term_demand(*market_frames(spark, sf), generic=GENERIC)


@query("K1_term_demand", f"WITH {MARKET_SQL}, {demand_sql()} SELECT query_id, term, count, live_count, company_count, source_count, share FROM demand")
def k1(spark, sf):
    return demand_frame(spark, sf).select("query_id", "term", "count", "live_count", "company_count", "source_count", "share")


# Only terms with a small market test the thresholds, so listings are also grouped finely by customer.
FINE_SQL = MARKET_SQL.replace("o_orderpriority AS query_id", "o_custkey AS query_id").replace(
    f"hints AS (SELECT query_id, term, bool_or(kind = 'primary') AS is_primary FROM {S.values(['query_id', 'term', 'kind'], HINTS)} GROUP BY ALL)",
    "hints AS (SELECT c_custkey AS query_id, term, bool_or(kind = 'primary') AS is_primary FROM customer CROSS JOIN (SELECT DISTINCT term, kind FROM " + S.values(["q", "term", "kind"], HINTS) + ") GROUP BY ALL)",
)


def fine_frames(spark, sf):
    listings, terms, n = market_rows(spark, sf)
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("c"))
    own = lambda df: df.join(owner, ["listing_id"]).withColumn("query_id", F.col("c")).drop("c")
    pairs = sorted({(t, k) for _, t, k in HINTS})
    kinds = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind")) for t, k in pairs])
    hints = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(kinds).alias("h")).select("query_id", "h.term", "h.kind")
    return own(listings), by_listing(own(terms), n), hints


@query(
    "K2_prune_demand",
    f"WITH {FINE_SQL}, {demand_sql()} SELECT query_id, term, share, rank FROM (SELECT query_id, term, share, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, term) AS rank FROM demand "
    f"WHERE {keep_sql('term IN ' + S.in_list(KNOWN_TERMS), GENERIC)}) WHERE rank <= 20",
)
def k2(spark, sf):
    known = values_frame(spark, ["term"], [(t,) for t in KNOWN_TERMS])
    demand = K.term_demand(*fine_frames(spark, sf), generic=GENERIC)
    marked = demand.join(known.withColumn("known", F.lit(True)), ["term"], "left").fillna(False, ["known"])
    kept = marked.filter(K.keep_demand(F.col("known"), GENERIC))
    return K.top_per_group(kept, ["query_id"], [F.desc("share"), F.asc("term")], 20, "rank").select("query_id", "term", "share", "rank")


# --- flagship: which terms does each source's text demand -----------------------

DOC_HINTS = (("article", "primary"), ("with", "market"))
DOC_MARKET_SQL = f"""{LEX_SQL}, {hits_sql('documents', 'doc_id', 'text')}, sigs AS (SELECT doc_id, {SIGNATURE_SQL} AS sig FROM documents),
  dup AS (SELECT doc_id, count(*) OVER (PARTITION BY sig) AS dup_divisor FROM sigs),
  listings AS (SELECT source AS query_id, doc_id AS listing_id, {pick_sql(FEED_NAMES[:4], 'doc_id % 4')} AS source, 'co ' || (doc_id % 7) AS company, lang AS title,
    CAST(doc_id % 10 AS DOUBLE) AS role_fit, CAST(NULL AS DOUBLE) AS listing_quality, dup_divisor FROM documents JOIN dup USING (doc_id)),
  terms AS (SELECT source AS query_id, doc_id AS listing_id, term, CAST(NULL AS DOUBLE) AS weight, count(*) AS n_evidence FROM hits JOIN documents USING (doc_id) GROUP BY ALL),
  hints AS (SELECT DISTINCT source AS query_id, term, kind = 'primary' AS is_primary FROM documents CROSS JOIN {S.values(['term', 'kind'], DOC_HINTS)})"""


def document_demand(spark, sf):
    docs = table(spark, sf, "documents")
    signed = docs.select("doc_id", "source", "lang", D.listing_signature(F.lit("feed"), F.col("lang"), F.col("lang"), F.col("text")).alias("signature"))
    listings = signed.select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("listing_id"), pick(FEED_NAMES[:4], F.col("doc_id") % 4).alias("source"),
        F.concat(F.lit("co "), F.col("doc_id") % 7).alias("company"), F.col("lang").alias("title"), (F.col("doc_id") % 10).cast("double").alias("role_fit"),
        F.lit(None).cast("double").alias("listing_quality"), "signature",
    )
    hits = E.match_terms(docs, ["source", "doc_id"], "text", lexicon(spark))
    terms = hits.select(F.col("source").alias("query_id"), F.col("doc_id").alias("listing_id"), "term", F.lit(None).cast("double").alias("weight"), F.col("n_hits").alias("n_evidence"))
    kinds = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind")) for t, k in DOC_HINTS])
    hints = docs.select(F.col("source").alias("query_id")).distinct().select("query_id", F.explode(kinds).alias("h")).select("query_id", "h.term", "h.kind")
    return K.term_demand(listings, terms, hints, generic=("que",))


@query(
    "K2_prune_demand_documents",
    f"WITH {DOC_MARKET_SQL}, {demand_sql(generic=('que',))} SELECT query_id, term, count, live_count, company_count, source_count, share, rank FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY query_id ORDER BY share DESC, term) AS rank FROM demand WHERE {keep_sql('term IN (' + S.q('and') + ', ' + S.q('of the') + ')', ('reporting',))}) WHERE rank <= 20",
)
def k2_documents(spark, sf):
    demand = K.prune_demand(document_demand(spark, sf), values_frame(spark, ["term"], [("and",), ("of the",)]))
    return demand.select("query_id", "term", "count", "live_count", "company_count", "source_count", "share", "rank")


# --- sample checks ----------------------------------------------------------------

K3_FLAGS = "CASE WHEN c_custkey % 7 = 0 THEN true ELSE false END AS sparse, c_custkey % 2 = 0 AS dense"


@query(
    "K3_market_sample_check",
    f"""WITH {FINE_SQL}, q AS (SELECT c_custkey AS query_id, {K3_FLAGS} FROM customer), lv AS (SELECT * FROM listings WHERE source <> 'role-baseline'),
    a AS (SELECT query_id, count(*) AS live_listings, count(DISTINCT nullif(lower(company), '')) AS companies, count(DISTINCT lower(title)) AS titles FROM lv GROUP BY 1),
    lt AS (SELECT DISTINCT t.query_id, term FROM terms t JOIN lv USING (query_id, listing_id)), b AS (SELECT query_id, count(*) AS live_terms FROM lt GROUP BY 1),
    e AS (SELECT h.query_id, count(*) AS n_exp, count(lt.term) AS n_hit FROM hints h LEFT JOIN lt ON lt.query_id = h.query_id AND lt.term = h.term GROUP BY 1),
    j AS (SELECT q.query_id, sparse, dense, coalesce(live_listings, 0) AS live_listings, coalesce(companies, 0) AS companies, coalesce(titles, 0) AS titles, coalesce(live_terms, 0) AS live_terms,
      n_hit / n_exp AS cover, greatest(4, CASE WHEN n_exp // 2 > 0 THEN n_exp // 2 ELSE 4 END) AS half FROM q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) JOIN e USING (query_id)),
    r AS (SELECT *, CASE WHEN live_listings < CASE WHEN sparse THEN 1 ELSE 4 END THEN 'too few live listings'
      WHEN live_terms < CASE WHEN sparse THEN 2 ELSE greatest(CASE WHEN dense THEN 5 ELSE 4 END, least(8, half)) END THEN 'too few distinct terms'
      WHEN cover < CASE WHEN sparse THEN 0.2 WHEN dense THEN 0.5 ELSE 0.42 END THEN 'role-defining terms missing'
      WHEN companies < CASE WHEN sparse THEN 1 ELSE 2 END OR titles < CASE WHEN sparse THEN 1 ELSE 2 END THEN 'one company or title dominates' ELSE '' END AS reason FROM j)
    SELECT query_id, live_listings, companies, titles, live_terms, {S.rnd('cover', 2)} AS coverage, reason <> '' AS needs_blend, reason FROM r""",
)
def k3(spark, sf):
    listings, terms, hints = fine_frames(spark, sf)
    key = F.col("c_custkey")
    queries = table(spark, sf, "customer").select(key.alias("query_id"), (key % 7 == 0).alias("sparse"), (key % 2 == 0).alias("dense_domain"))
    return K.market_sample_check(listings, terms, hints.select("query_id", "term"), queries)


CONTEXT_SQL = "listing_tiers AS (SELECT *, CASE listing_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS bc, CASE listing_id % 2 WHEN 0 THEN 'none' ELSE 'exact' END AS st FROM listings)"


@query(
    "K4_market_context",
    f"""WITH {FINE_SQL}, {CONTEXT_SQL}, a AS (SELECT c_custkey AS query_id, count(*) FILTER (source <> 'role-baseline') AS live_listings, count(*) FILTER (source = 'role-baseline') AS baseline_listings,
      count(DISTINCT nullif({S.clean_label('company')}, '')) FILTER (source <> 'role-baseline') AS live_companies,
      list_distinct(list(coalesce(bc, 'medium')) FILTER (source = 'role-baseline')) AS bcs, list_distinct(list(st) FILTER (source = 'role-baseline')) AS sts FROM customer LEFT JOIN listing_tiers ON query_id = c_custkey GROUP BY 1),
    s AS (SELECT query_id, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT query_id, source, count(*) AS n FROM listings WHERE source <> 'role-baseline' GROUP BY ALL) GROUP BY 1)
    SELECT query_id, CASE WHEN baseline_listings > 0 AND live_listings = 0 THEN 'role-baseline' WHEN baseline_listings > 0 THEN 'blended-market' WHEN live_listings > 0 THEN 'live-jobs' ELSE 'none' END AS market_source,
      live_listings, baseline_listings, live_companies, baseline_listings > 0 AS used_role_baseline, coalesce(sources, '') AS sources,
      CASE WHEN bcs = ['low'] THEN 'low' WHEN bcs = ['high'] THEN 'high' ELSE 'medium' END AS baseline_confidence,
      CASE WHEN sts = ['none'] THEN 'none' WHEN sts = ['exact'] THEN 'exact' ELSE 'heuristic' END AS baseline_support_tier,
      CASE WHEN live_listings >= 6 AND live_companies >= 3 AND baseline_listings = 0 THEN 'high' WHEN live_listings >= 3 THEN 'medium' WHEN baseline_listings > 0 THEN 'baseline-assisted' ELSE 'low' END AS market_confidence
    FROM a LEFT JOIN s USING (query_id)""",
)
def k4(spark, sf):
    listings, _, _ = fine_frames(spark, sf)
    key = F.col("listing_id")
    tiers = listings.withColumns({"baseline_confidence": F.when(key % 3 == 0, "low").when(key % 3 == 1, "high"), "support_tier": F.when(key % 2 == 0, "none").otherwise("exact")})
    out = K.market_context(tiers, table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id")))
    flat = F.array_join(F.transform(F.map_entries("live_source_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("sources", F.coalesce(flat, F.lit(""))).drop("live_source_counts")


@query(
    "K5_market_confidence_factor",
    """SELECT o_orderkey, CAST(CASE WHEN lv > 0 THEN CASE WHEN b > 0 THEN least(f, 0.9) ELSE f END WHEN b > 0 THEN CASE c WHEN 'high' THEN 0.72 WHEN 'medium' THEN 0.55 ELSE 0 END ELSE 1 END AS DOUBLE) AS factor,
      CAST(CASE WHEN b > 0 AND lv = 0 THEN 0.82 WHEN b > 0 THEN 0.9 ELSE 1 END AS DOUBLE) AS simple_factor
    FROM (SELECT *, CASE WHEN lv >= 6 AND co >= 3 THEN 1.0 WHEN lv >= 4 THEN 0.92 WHEN lv >= 2 THEN 0.84 ELSE 0.76 END AS f
      FROM (SELECT o_orderkey, o_orderkey % 9 AS lv, o_custkey % 5 AS co, o_custkey % 3 AS b, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS c FROM orders))""",
)
def k5(spark, sf):
    live, companies, base = F.col("o_orderkey") % 9, F.col("o_custkey") % 5, F.col("o_custkey") % 3
    confidence = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return table(spark, sf, "orders").select(
        "o_orderkey", K.market_confidence_factor(live, companies, base, confidence).alias("factor"), K.simple_confidence_factor(live, base).alias("simple_factor")
    )


@query("K6_count_by_source", "SELECT lower(source) AS source, count(*) AS n FROM documents GROUP BY 1")
def k6(spark, sf):
    return K.count_by_source(table(spark, sf, "documents"))


# --- attempt log: events are fetch attempts ----------------------------------------

ATTEMPTS_SQL = """attempts AS (SELECT event_id, event_type AS source, 'stage' || (event_id % 6) AS stage, user_id AS query, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'skipped_budget' ELSE 'failed' END AS status,
  CASE WHEN event_id % 4 < 2 THEN '' WHEN event_id % 8 = 2 THEN 'Read Timeout after ' || (event_id % 3) ELSE 'http ' || (400 + event_id % 5) END AS error, value - 20 AS elapsed_ms, user_id % 12 AS result_count FROM events)"""


def attempts_of(events):
    key = F.col("event_id")
    error = F.when(key % 4 < 2, "").when(key % 8 == 2, F.concat(F.lit("Read Timeout after "), key % 3)).otherwise(F.concat(F.lit("http "), key % 5 + 400))
    return events.select(
        key.alias("attempt_id"), F.col("event_type").alias("source"), F.concat(F.lit("stage"), key % 6).alias("stage"), F.col("user_id").alias("query"), "ts",
        F.when(key % 4 == 0, "success").when(key % 4 == 1, "skipped_budget").otherwise("failed").alias("status"), error.alias("error"),
        (F.col("value") - 20).alias("elapsed_ms"), (F.col("user_id") % 12).alias("result_count"),
    )


def attempts_frame(spark, sf):
    return attempts_of(table(spark, sf, "events"))


def _first_values(col: str, k: int) -> str:
    return f"(SELECT string_agg(v, '|' ORDER BY first_at, v) FROM (SELECT CAST({col} AS VARCHAR) AS v, min(event_id) AS first_at FROM attempts b WHERE b.source = a.source AND CAST({col} AS VARCHAR) <> '' GROUP BY 1 ORDER BY first_at, v LIMIT {k}))"


@query(
    "K7_attempt_rollup",
    f"""WITH {ATTEMPTS_SQL} SELECT source, count(*) AS requests, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'skipped_budget') AS skipped_budget,
      count(*) FILTER (contains(lower(error), 'timeout')) AS timeouts, count(*) FILTER (error <> '') AS errors, CAST(sum(result_count) AS BIGINT) AS raw_returned,
      {S.rnd('avg(elapsed_ms) FILTER (elapsed_ms > 0)', 2)} AS avg_elapsed_ms, {S.rnd('max(elapsed_ms) FILTER (elapsed_ms > 0)', 2)} AS max_elapsed_ms,
      {_first_values('query', 8)} AS queries, {_first_values('stage', 4)} AS stages, {_first_values('error', 3)} AS error_samples FROM attempts a GROUP BY source""",
)
def k7(spark, sf):
    out = K.attempt_rollup(attempts_frame(spark, sf))
    for c in ("queries", "stages", "error_samples"):
        out = out.withColumn(c, F.array_join(c, "|"))
    return out


FLAGS_SQL = "flagged AS (SELECT o_orderpriority AS query_id, l_returnflag AS source, 'stage' || (l_linenumber % 3) AS stage, l_quantity > 20 AS precise, l_discount > 0.05 AS backup, l_tax > 0.04 AS recovery, l_quantity > 10 AS safe, l_quantity > 45 AS selected FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def flagged_frame(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(
        F.col("o_orderpriority").alias("query_id"), F.col("l_returnflag").alias("source"), F.concat(F.lit("stage"), F.col("l_linenumber") % 3).alias("stage"),
        (F.col("l_quantity") > 20).alias("precise"), (F.col("l_discount") > 0.05).alias("backup"), (F.col("l_tax") > 0.04).alias("recovery"),
        (F.col("l_quantity") > 10).alias("safe"), (F.col("l_quantity") > 45).alias("selected"),
    )


@query(
    "K8_selection_funnel",
    f"WITH {FLAGS_SQL} SELECT query_id, source, count(*) AS raw, " + ", ".join(f"count(*) FILTER ({s}) AS {s}" for s in K.FUNNEL_STAGES) + " FROM flagged GROUP BY ALL",
)
def k8(spark, sf):
    return K.selection_funnel(flagged_frame(spark, sf))


UNDERFILL = "CASE WHEN {s} >= {f} THEN 'sufficient_live_supply' WHEN {p} >= {f} THEN 'selector_over_pruning' WHEN {t} > 0 THEN 'provider_timeout_or_upstream_scarcity' WHEN {e} > 0 THEN 'provider_error_or_upstream_scarcity' ELSE 'upstream_scarcity' END"


@query("K9_underfill_reason", f"SELECT o_orderkey, {UNDERFILL.format(s='o_orderkey % 13', p='o_orderkey % 17', f='10', t='o_custkey % 3', e='o_custkey % 2')} AS reason FROM orders")
def k9(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", K.underfill_reason(key % 13, key % 17, F.lit(10), cust % 3, cust % 2).alias("reason"))


@query(
    "K10_fallback_baseline",
    """WITH m AS (SELECT o_custkey AS query_id, o_orderkey, p_name AS term FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    d AS (SELECT query_id, term, min(o_orderkey) AS first_at FROM m GROUP BY ALL), r AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY first_at, term) - 1 AS pos FROM d),
    k AS (SELECT * FROM r WHERE pos < 2 + query_id % 6), n AS (SELECT query_id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2),
    v AS (SELECT k.*, n.n, number FROM k JOIN n USING (query_id) CROSS JOIN (SELECT unnest(range(1, 6)) AS number)),
    w AS (SELECT *, least(number, 3) AS profile FROM v),
    f AS (SELECT * FROM w WHERE n <= 3 OR pos = 0 OR (pos <= 2 AND profile IN (1, 2)) OR (pos IN (3, 4) AND profile IN (1, 3)) OR (pos > 4 AND profile = 3)),
    g AS (SELECT f.*, 'Customer#' || lpad(CAST(query_id AS VARCHAR), 9, '0') AS role, """ + S.rnd("greatest(CAST(0.58 AS DOUBLE), 1 - pos / greatest(n - 1, 1) * CAST(0.38 AS DOUBLE))", 2) + """ AS w FROM f)
    SELECT query_id, lower(replace(role, '#', '-')) || '-' || number AS external_id, replace((['{}', 'Junior {}', 'Entry-Level {}', 'Associate {}', 'Remote {}'])[number], '{}', upper(role[1]) || lower(role[2:])) AS title, term,
      CASE WHEN n >= 4 THEN w WHEN n = 3 THEN least(w, CAST(0.78 AS DOUBLE)) ELSE least(w, CAST(0.68 AS DOUBLE)) END AS weight,
      CASE WHEN n >= 4 THEN 'high' WHEN n = 3 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN n >= 4 THEN CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'family' END WHEN n = 3 THEN 'heuristic' ELSE 'none' END AS support_tier FROM g""",
)
def k10(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    first = lines.groupBy(F.col("o_custkey").alias("query_id"), F.col("p_name").alias("term")).agg(F.min("o_orderkey").alias("at"))
    ranked = K.top_per_group(first, ["query_id"], [F.asc("at"), F.asc("term")], 8, "rank")
    model = ranked.filter(F.col("rank") <= F.col("query_id") % 6 + 2).select("query_id", "term", (F.col("rank") - 1).alias("pos"))
    queries = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("role"), (F.col("c_custkey") % 2 == 0).alias("family_exact"))
    return K.fallback_baseline(queries, model, count=5).select("query_id", "external_id", "title", "term", "weight", "confidence", "support_tier")


@query(
    "K11_stage_summary",
    f"""WITH {FLAGS_SQL}, att AS (SELECT o_orderpriority AS query_id, 'stage' || (o_orderkey % 3) AS stage, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 97 = 0) AS timeouts, count(*) FILTER (o_orderstatus = 'P') AS errors FROM orders GROUP BY ALL),
    c AS (SELECT query_id, stage, count(*) AS candidates, count(*) FILTER (selected) AS selected, count(*) FILTER (precise) AS precise, count(*) FILTER (safe) AS safe FROM flagged GROUP BY ALL),
    fl AS (SELECT DISTINCT o_orderpriority AS query_id, CASE WHEN o_orderpriority < '3' THEN 100000000 ELSE 450 END AS floor FROM orders)
    SELECT query_id, stage, candidates, selected, precise, safe, {UNDERFILL.format(s='selected', p='safe', f='floor', t='coalesce(timeouts, 0)', e='coalesce(errors, 0)')} AS underfill_reason
    FROM c LEFT JOIN att USING (query_id, stage) JOIN fl USING (query_id)""",
)
def k11(spark, sf):
    orders = table(spark, sf, "orders")
    attempts = orders.select(
        F.col("o_orderpriority").alias("query_id"), F.concat(F.lit("stage"), F.col("o_orderkey") % 3).alias("stage"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 97 == 0)).cast("int").alias("timeouts"), (F.col("o_orderstatus") == "P").cast("int").alias("errors"),
    )
    floors = orders.select(F.col("o_orderpriority").alias("query_id")).distinct().withColumn("floor", F.when(F.col("query_id") < "3", 100000000).otherwise(450))
    return K.stage_summary(flagged_frame(spark, sf), attempts, floors)
