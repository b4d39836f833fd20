"""Market aggregates: term demand, pruning, sample checks, attempt log, baseline listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators.ranking import top_per_group, with_group_size

# --- fixed values -------------------------------------------------------------
DEFAULT_FIT, DEFAULT_QUALITY, LIVE_WEIGHT, BASELINE_WEIGHT = 0.0, 10.0, 0.82, 0.70
BASELINE_DAMPING = 0.62
DEMAND_LIMIT = 20
# ------------------------------------------------------------------------------


def is_live_source(source: Column) -> Column:
    return source != X.BASELINE_SOURCE


def trust(source: Column, table: Mapping[str, float], other: float) -> Column:
    return F.coalesce(F.try_element_at(T.lit_map(table), F.lower(source)), F.lit(other))


def job_columns(trust_table: Mapping[str, float], trust_other: float) -> dict[str, Column]:
    """Per listing: source, live, company, low_title, and job_weight before damping and the duplicate divisor."""
    base = trust(F.col("source"), trust_table, trust_other)
    fit = F.lit(0.45) + F.least(F.coalesce("role_fit", F.lit(DEFAULT_FIT)), F.lit(8.0)) / 8
    quality = F.lit(0.65) + F.least(F.coalesce("listing_quality", F.lit(DEFAULT_QUALITY)), F.lit(20.0)) / 28
    low_title = F.lower(T.normalize_ws(F.col("title")))
    company = F.coalesce(F.nullif(F.lower(T.normalize_ws(F.col("company"))), F.lit("")), F.concat_ws(":", F.lower("source"), F.substring(low_title, 1, 48)))
    return {"source": F.lower("source"), "live": is_live_source(F.col("source")), "company": company, "low_title": low_title, "job_weight": base * fit * quality}


def term_weight(generic: Sequence[str]) -> Column:
    """Weight of a listing's term from weight, live, low_title, n_evidence, primary and hinted."""
    w = F.coalesce("weight", F.when(F.col("live"), LIVE_WEIGHT).otherwise(BASELINE_WEIGHT))
    up = lambda c, cond, add: F.when(cond, F.least(F.lit(1.0), c + add)).otherwise(c)
    w = up(w, F.contains(F.col("low_title"), F.col("term")), 0.12)
    w = up(w, F.col("n_evidence") > 1, 0.06)
    w = F.when(F.col("primary"), F.least(F.lit(1.0), w + 0.08)).when(F.col("hinted"), F.least(F.lit(1.0), w + 0.03)).otherwise(w * 0.86)
    return F.when(F.col("term").isin(*generic) & ~F.col("primary"), w * 0.72).otherwise(w)


def listing_terms(terms: DataFrame, *values: str) -> DataFrame:
    """One row for each listing and term with its largest ``values``; ``lead`` marks one row of each listing.

    One sort by (query, listing, term) serves both, and the join on the listing that follows. A hash of the rows would hold
    them all beside that sort, as hardly any two agree. A listing has at most as many terms as the lexicon.
    """
    own = Window.partitionBy("query_id", "listing_id").orderBy("term")
    same = own.rangeBetween(Window.currentRow, Window.currentRow)
    number = F.row_number().over(own)
    first = (number == 1) | ~F.lag("term").over(own).eqNullSafe(F.col("term"))
    rows = terms.select("query_id", "listing_id", "term", *[F.max(c).over(same).alias(c) for c in values], (number == 1).alias("lead"), first.alias("__first"))
    return rows.filter("__first").drop("__first")


def demand_pairs(jobs: DataFrame, terms: DataFrame, hints: DataFrame) -> DataFrame:
    """One row for each listing and term, with the flags of the hints; ``lead`` marks one row of each listing."""
    kinds = hints.groupBy("query_id", "term").agg(F.max((F.col("kind") == "primary")).alias("primary"), F.lit(True).alias("hinted"))
    # The leading row of a listing carries its weight for the denominator.
    once = listing_terms(terms, "weight", "n_evidence")
    return once.join(jobs, ["query_id", "listing_id"]).join(kinds, ["query_id", "term"], "left").fillna(False, ["primary", "hinted"])


def term_demand(
    listings: DataFrame, terms: DataFrame, hints: DataFrame, trust_table: Mapping[str, float] = X.DEMAND_TRUST,
    trust_other: float = X.DEMAND_TRUST_OTHER, generic: Sequence[str] = X.GENERIC_SECONDARY_TERMS,
) -> DataFrame:
    """Weighted demand share of each term per query.

    listings: query_id, listing_id, source, company, title, role_fit, listing_quality, and
              dup_divisor, or signature to have the divisor counted here
    terms:    query_id, listing_id, term, weight (null = default), n_evidence
    hints:    query_id, term, kind (primary or market)

    share = 100 * sum(job weight * term weight) / sum(job weight of listings with terms).
    The pairs are read once. They are first summed by (query, term, company, source), which
    spreads a term that most listings name, then by (query, term) over those small rows.
    """
    live = is_live_source(F.col("source"))
    # Queries with live rows damp their baseline rows: one small row per query, joined to the sums. Joined to the listings,
    # it would bring all those of a query together in one task.
    per_query = listings.groupBy("query_id").agg(F.max(live).alias("live_present"), F.count_if(live).alias("live_listings"))
    if "signature" in listings.columns:
        listings = with_group_size(listings, ["signature"], "dup_divisor")
    columns = job_columns(trust_table, trust_other)
    weight = columns.pop("job_weight") / F.greatest(F.col("dup_divisor"), F.lit(1))
    jobs = listings.select("query_id", "listing_id", weight.alias("job_weight"), *[c.alias(n) for n, c in columns.items()])
    pairs, w = demand_pairs(jobs, terms, hints), term_weight(generic)
    per_company = pairs.groupBy("query_id", "term", "company", "source", "live").agg(
        F.sum(F.col("job_weight") * w).alias("weighted"), F.sum(F.when(F.col("lead"), F.col("job_weight")).otherwise(0.0)).alias("jobs"), F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in ("primary", "hinted")],
    )
    damping = F.when(F.col("live_present") & ~F.col("live"), BASELINE_DAMPING).otherwise(1.0)
    scaled = per_company.join(per_query, ["query_id"]).withColumns({c: F.col(c) * damping for c in ("weighted", "jobs")})
    demand = scaled.groupBy("query_id", "term").agg(
        F.sum("weighted").alias("weighted"), F.sum("jobs").alias("jobs"), F.sum("n").alias("count"), F.coalesce(F.sum(F.when(F.col("live"), F.col("n"))), F.lit(0)).alias("live_count"), *[F.max(c).alias(c) for c in ("primary", "hinted", "live_present", "live_listings")],
        F.count_distinct("company").alias("company_count"), F.count_distinct("source").alias("source_count"),
    )
    # A query has at most as many rows here as the lexicon has terms.
    out = demand.withColumn("total", F.sum("jobs").over(Window.partitionBy("query_id"))).filter("total > 0")
    return out.withColumn("share", F.round(F.col("weighted") / F.col("total") * 100, 1)).drop("weighted", "jobs", "total")


def keep_demand(known: Column, generic: Sequence[str] = X.GENERIC_SECONDARY_TERMS) -> Column:
    """Does a demand row carry enough evidence? Thresholds by hint kind."""
    c = F.col
    live, share, companies = c("live_count"), c("share"), c("company_count")
    baseline_only = c("live_present") & (live == 0)
    weak = lambda bar: (live < 2) & (companies < 2) & (share < bar)
    primary_ok = ~(baseline_only & (share < 18.0))
    dense = c("live_present") & (c("live_listings") >= 6) & (live >= 1) & (share >= 7.0)
    hinted_ok = dense | ~((c("live_present") & weak(11.0)) | (c("term").isin(*generic) & (live < 2) & (share < 13.0)))
    broad = c("live_present") & (c("live_listings") >= 8) & (live >= 1) & (share >= 8.0)
    known_ok = broad | ~(weak(13.0) | ((c("count") < 2) & (companies < 2)))
    unknown_ok = (c("count") >= 3) & (companies >= 2) & (share >= 10.0)
    by_kind = F.when(c("primary"), primary_ok).when(c("hinted"), hinted_ok).when(known, known_ok).otherwise(unknown_ok)
    return ~(baseline_only & ~c("primary")) & by_kind


def prune_demand(demand: DataFrame, known: DataFrame, limit: int = DEMAND_LIMIT) -> DataFrame:
    """Demand rows with enough evidence, the best ``limit`` per query. ``known`` is (term)."""
    marked = demand.join(known.select("term").distinct().withColumn("known", F.lit(True)), ["term"], "left").fillna(False, ["known"])
    return top_per_group(marked.filter(keep_demand(F.col("known"))), ["query_id"], [F.desc("share"), F.asc("term")], limit, "rank")


def market_sample_check(listings: DataFrame, terms: DataFrame, expected: DataFrame, queries: DataFrame, display_minimum: int = 12) -> DataFrame:
    """Is the live sample of a query deep and wide enough, and if not, why.

    queries: query_id, sparse, dense_domain; expected: query_id, term.
    """
    live = listings.filter(is_live_source(F.col("source")))
    text = lambda c: F.nullif(F.lower(T.normalize_ws(F.col(c))), F.lit(""))
    seen = live.groupBy("query_id").agg(F.count(F.lit(1)).alias("live_listings"))
    spread = lambda c, name: live.select("query_id", text(c).alias("v")).filter("v IS NOT NULL").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    live_terms = terms.join(live.select("query_id", "listing_id"), ["query_id", "listing_id"], "left_semi").select("query_id", "term").distinct()
    n_terms = live_terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("live_terms"))
    want = expected.select("query_id", "term").distinct().join(live_terms.withColumn("hit", F.lit(1)), ["query_id", "term"], "left")
    cover = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_hit"))
    out = queries
    for part in (seen, spread("company", "companies"), spread("title", "titles"), n_terms, cover):
        out = out.join(part, ["query_id"], "left")
    out = out.fillna(0, ["live_listings", "companies", "titles", "live_terms", "n_expected", "n_hit"])
    c, sparse = F.col, F.col("sparse")
    coverage = F.when(c("n_expected") > 0, c("n_hit") / c("n_expected")).otherwise(F.lit(1.0))
    half = F.greatest(F.lit(4), F.when(F.floor(c("n_expected") / 2) > 0, F.floor(c("n_expected") / 2)).otherwise(F.lit(4)))
    min_terms = F.when(sparse, 2).otherwise(F.greatest(F.when(c("dense_domain"), 5).otherwise(4), F.least(F.lit(8), half)))
    min_cover = F.when(sparse, 0.2).when(c("dense_domain"), 0.5).otherwise(0.42)
    min_rows, min_two = F.when(sparse, 1).otherwise(4), F.when(sparse, 1).otherwise(2)
    few, thin, gaps = c("live_listings") < min_rows, c("live_terms") < min_terms, coverage < min_cover
    narrow = (c("companies") < min_two) | (c("titles") < min_two)
    reason = F.when(few, "too few live listings").when(thin, "too few distinct terms").when(gaps, "role-defining terms missing").when(narrow, "one company or title dominates").otherwise("")
    return out.select(
        "query_id", "live_listings", "companies", "titles", "live_terms", F.round(coverage, 2).alias("coverage"),
        (few | thin | gaps | narrow).alias("needs_blend"), reason.alias("reason"),
    )


def market_context(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """Counts, source mix and confidence of a query's market sample."""
    live = is_live_source(F.col("source"))
    company = F.nullif(T.clean_label(F.col("company")), F.lit(""))
    base = listings.groupBy("query_id").agg(
        F.count_if(live).alias("live_listings"), F.count_if(~live).alias("baseline_listings"),
        F.min(F.when(~live, F.coalesce("baseline_confidence", F.lit("medium")))).alias("low_c"), F.max(F.when(~live, F.coalesce("baseline_confidence", F.lit("medium")))).alias("high_c"),
        F.min(F.when(~live, F.coalesce("support_tier", F.lit("heuristic")))).alias("low_t"), F.max(F.when(~live, F.coalesce("support_tier", F.lit("heuristic")))).alias("high_t"),
    )
    companies = listings.filter(live).select("query_id", company.alias("v")).filter("v IS NOT NULL").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("live_companies"))
    per_source = listings.filter(live).groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))
    # The map holds one entry per feed, a handful.
    sources = per_source.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("live_source_counts"))
    out = queries.select("query_id")
    for part in (base, companies, sources):
        out = out.join(part, ["query_id"], "left")
    out = out.fillna(0, ["live_listings", "baseline_listings", "live_companies"])
    c = F.col
    used = c("baseline_listings") > 0
    only = lambda v, lo, hi: (c(lo) == v) & (c(hi) == v)
    confidence = F.when(only("low", "low_c", "high_c"), "low").when(only("high", "low_c", "high_c"), "high").otherwise("medium")
    tier = F.when(only("none", "low_t", "high_t"), "none").when(only("exact", "low_t", "high_t"), "exact").otherwise("heuristic")
    market = F.when((c("live_listings") >= 6) & (c("live_companies") >= 3) & ~used, "high").when(c("live_listings") >= 3, "medium").when(used, "baseline-assisted").otherwise("low")
    source = F.when(used & (c("live_listings") == 0), X.BASELINE_SOURCE).when(used, "blended-market").when(c("live_listings") > 0, "live-jobs").otherwise("none")
    return out.select(
        "query_id", source.alias("market_source"), "live_listings", "baseline_listings", "live_companies", used.alias("used_role_baseline"), "live_source_counts",
        confidence.alias("baseline_confidence"), tier.alias("baseline_support_tier"), market.alias("market_confidence"),
    )


def market_confidence_factor(live: Column, companies: Column, baseline: Column, confidence: Column) -> Column:
    """Discount on market-based scores by the depth of the sample."""
    by_live = F.when((live >= 6) & (companies >= 3), 1.0).when(live >= 4, 0.92).when(live >= 2, 0.84).otherwise(0.76)
    blended = F.when(baseline > 0, F.least(by_live, F.lit(0.9))).otherwise(by_live)
    baseline_only = F.when(confidence == "high", 0.72).when(confidence == "medium", 0.55).otherwise(0.0)
    return F.when(live > 0, blended).when(baseline > 0, baseline_only).otherwise(1.0)


def simple_confidence_factor(live: Column, baseline: Column) -> Column:
    return F.when((baseline > 0) & (live == 0), 0.82).when(baseline > 0, 0.9).otherwise(1.0)


def count_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(F.lower(F.coalesce(source, F.lit("unknown"))).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def attempt_rollup(attempts: DataFrame, seq: str = "attempt_id", n_queries: int = 8, n_stages: int = 4, n_errors: int = 3) -> DataFrame:
    """One row per source over the attempt log; samples are the first distinct values by ``seq``."""
    err = F.trim(F.coalesce("error", F.lit("")))
    ms = F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))
    src = F.lower(F.coalesce("source", F.lit("unknown")))
    rows = attempts.withColumn("source", src)
    main = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "skipped_budget").alias("skipped_budget"),
        F.count_if(F.contains(F.lower(err), F.lit("timeout"))).alias("timeouts"), F.count_if(err != "").alias("errors"), F.coalesce(F.sum("result_count"), F.lit(0)).alias("raw_returned"),
        F.round(F.coalesce(F.avg(ms), F.lit(0.0)), 2).alias("avg_elapsed_ms"), F.round(F.coalesce(F.max(ms), F.lit(0.0)), 2).alias("max_elapsed_ms"),
    )
    for name, col, k in (("queries", F.trim(F.coalesce(F.col("query").cast("string"), F.lit(""))), n_queries), ("stages", F.trim(F.coalesce("stage", F.lit(""))), n_stages), ("error_samples", err, n_errors)):
        # First sighting of each value (partially aggregated), then the first k of them.
        first = rows.select("source", col.alias("v"), seq).filter("v <> ''").groupBy("source", "v").agg(F.min(seq).alias("at"))
        top = top_per_group(first, ["source"], [F.asc("at"), F.asc("v")], k)
        listed = top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))
        main = main.join(listed, ["source"], "left")
    return main


FUNNEL_STAGES = ("precise", "backup", "recovery", "safe", "selected")


def selection_funnel(flagged: DataFrame, by: Sequence[str] = ("query_id", "source")) -> DataFrame:
    """Rows per source that reach each selection stage (boolean columns)."""
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col(s)).alias(s) for s in FUNNEL_STAGES])


def underfill_reason(selected: Column, safe: Column, floor: Column, timeouts: Column, errors: Column) -> Column:
    """Why a query has fewer rows than its floor."""
    return (
        F.when(selected >= floor, "sufficient_live_supply")
        .when(safe >= floor, "selector_over_pruning")
        .when(timeouts > 0, "provider_timeout_or_upstream_scarcity")
        .when(errors > 0, "provider_error_or_upstream_scarcity")
        .otherwise("upstream_scarcity")
    )


def stage_summary(flagged: DataFrame, attempts: DataFrame, floors: DataFrame) -> DataFrame:
    """Per query and fetch stage: candidates, selected, precise, safe, and why it is short."""
    counts = flagged.groupBy("query_id", "stage").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("selected"), F.count_if("precise").alias("precise"), F.count_if("safe").alias("safe")
    )
    trouble = attempts.groupBy("query_id", "stage").agg(F.sum("timeouts").alias("timeouts"), F.sum("errors").alias("errors"))
    joined = counts.join(trouble, ["query_id", "stage"], "left").fillna(0, ["timeouts", "errors"]).join(floors, ["query_id"])
    reason = underfill_reason(F.col("selected"), F.col("safe"), F.col("floor"), F.col("timeouts"), F.col("errors"))
    return joined.select("query_id", "stage", "candidates", "selected", "precise", "safe", reason.alias("underfill_reason"))


# --- baseline listings ------------------------------------------------------------
TITLE_FORMS = ("{}", "Junior {}", "Entry-Level {}", "Associate {}", "Remote {}", "{} Specialist", "{} Coordinator", "Early Career {}", "{} Associate", "{} Trainee")


def fallback_baseline(queries: DataFrame, model: DataFrame, count: int = 3) -> DataFrame:
    """Modelled listings for queries with a thin sample: (query_id, external_id, title, term, weight, confidence).

    queries: query_id, role, family_exact; model: query_id, term, pos (0 = most typical).
    Listing 1, 2 and 3 take terms by rank: all take the first; 1 and 2 the next two;
    1 and 3 the two after; 3 the rest. With up to three terms each takes all.
    """
    total = model.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = model.join(total, ["query_id"]).filter("n >= 2").join(queries, ["query_id"])
    confidence = F.when(F.col("n") >= 4, "high").when(F.col("n") >= 3, "medium").otherwise("low")
    variant = F.when((F.col("n") <= 3) | (F.col("pos") == 0), F.array(*[F.lit(i) for i in (1, 2, 3)])).when(F.col("pos") <= 2, F.array(F.lit(1), F.lit(2))).when(
        F.col("pos") <= 4, F.array(F.lit(1), F.lit(3))
    ).otherwise(F.array(F.lit(3)))
    weight = F.round(F.greatest(F.lit(0.58), F.lit(1.0) - F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1)) * 0.38), 2)
    capped = F.when(F.col("n") >= 4, weight).when(F.col("n") == 3, F.least(weight, F.lit(0.78))).otherwise(F.least(weight, F.lit(0.68)))
    spread = ranked.select("query_id", "role", "family_exact", "term", "pos", "n", confidence.alias("confidence"), capped.alias("weight"), F.explode(variant).alias("variant"))
    # Listings beyond the third repeat the third term profile.
    numbers = F.when(F.col("variant") < 3, F.array("variant")).otherwise(F.when(F.lit(count) >= 3, F.sequence(F.lit(3), F.lit(max(count, 3)))).otherwise(F.array().cast("array<int>")))
    listed = spread.withColumn("number", F.explode(numbers)).filter(F.col("number") <= count)
    forms = F.element_at(T.lit_array(TITLE_FORMS), F.col("number"))
    role = F.initcap("role")
    return listed.select(
        "query_id", F.concat_ws("-", T.slugify(F.col("role")), F.col("number")).alias("external_id"), F.replace(forms, F.lit("{}"), role).alias("title"),
        F.lit(X.BASELINE_SOURCE).alias("source"), "number", "term", "pos", "weight", "confidence",
        F.when(F.col("n") >= 4, F.when(F.col("family_exact"), "exact").otherwise("family")).when(F.col("n") >= 3, "heuristic").otherwise("none").alias("support_tier"),
    )
