"""Gap analysis: which demanded terms a document proves, lacks, or only names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators.ranking import first_per_key, top_per_group
from docmarket.session import cut_lineage

# --- fixed values -------------------------------------------------------------
GAP_LIMIT, RECOMMENDED = 10, 14
SIGNAL_PRIORITY = {"live": 4, "weak-resume-proof": 3, "live-support": 2, "role-family": 1}
ACTION_CONTEXT = r"(?iU)\b(built|created|developed|analyzed|cleaned|designed|improved|automated|delivered)\b"
REQUIREMENT_LANGUAGE = r"(?iU)\b(required|requirements|must have|proficient in|experience with|hands[- ]on)\b"
# ------------------------------------------------------------------------------


def required_proof(primary: Column, hinted: Column, share: Column, live_count: Column, companies: Column, live_listings: Column, dense: Column, years: Column) -> Column:
    """Proof a term needs to count as matched."""
    early, repeated = F.coalesce(years, F.lit(0.0)) < 1.5, (live_count >= 2) | (companies >= 2)
    return (
        F.when(primary & (share >= 8.0) & (dense | early), 0.86)
        .when(hinted & early & (share >= 10.0) & (repeated | (live_listings >= 8)), 0.84)
        .when(hinted & dense & (share >= 12.0) & repeated, 0.82)
        .otherwise(X.PROOF_WEIGHTS["medium"])
    )


def split_matched(proved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, missing) of (doc_id, query_id, term, share, proof, required, has_term)."""
    matched = proved.filter(F.col("proof") >= F.col("required"))
    missing = proved.filter(F.col("proof") < F.col("required"))
    return matched, missing.withColumn("signal_source", missing_source())


def missing_source() -> Column:
    return F.when(F.col("has_term"), "weak-resume-proof").otherwise("live")


def match_status(proved: DataFrame) -> DataFrame:
    """Both lists of :func:`split_matched` in one pass, told apart by ``status``: matched, or the source of a missing term."""
    return proved.withColumn("status", F.when(F.col("proof") >= F.col("required"), "matched").otherwise(missing_source()))


def live_gap_evidence(listings: DataFrame, stored: DataFrame, declared: DataFrame, literal: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First evidence per (query, term, company): stored snippet, else a listing that declares the term, else a literal mention.

    listings: query_id, listing_id, source, company, title, description, arrival
    stored and literal: query_id, listing_id, term, snippet; declared: query_id, listing_id, term
    """
    # What is cleaned is cleaned once per listing; the text of a declaring listing only where it is the first of its company.
    company = F.coalesce(F.nullif(F.lower(T.normalize_ws(F.col("company"))), F.lit("")), F.lit("unknown"))
    text = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("title"))
    live = listings.filter(F.col("source") != X.BASELINE_SOURCE).select("query_id", "listing_id", "source", F.col(arrival).alias("__arrival"), company.alias("company_key"), text.alias("__text"))
    keys = ["query_id", "listing_id", "term"]
    tier = lambda df, n: df.select(*keys, F.lit(n).alias("tier"), "snippet")
    own = declared.select(*keys).withColumn("snippet", F.lit(None).cast("string"))
    evidence = tier(stored, 0).unionByName(tier(own, 1)).unionByName(tier(literal, 2))
    best = evidence.groupBy(*keys).agg(F.min(F.struct("tier", "snippet")).alias("b")).select(*keys, "b.*")
    first = first_per_key(best.join(live, ["query_id", "listing_id"]), ["query_id", "term", "company_key"], [F.asc("__arrival")])
    head = F.substring(T.normalize_ws(F.col("__text")), 1, 220)
    return first.select("query_id", "term", "company_key", "listing_id", "tier", F.when(F.col("tier") == 1, head).otherwise(F.col("snippet")).alias("snippet"), "source")


def augment_gaps(existing: DataFrame, demand: DataFrame, recommended: DataFrame, evidence: DataFrame, proofs: DataFrame, context: DataFrame, limit: int = GAP_LIMIT) -> DataFrame:
    """Gap list of a document: its missing terms, topped up to the query's target.

    existing:    doc_id, query_id, term, share, signal_source
    demand:      query_id, term, share, live_count, company_count
    recommended: query_id, term, pos (1 = first, at most 14)
    evidence:    query_id, term, n_companies
    proofs:      doc_id, query_id, term, has_term, proof, required (all demanded and recommended terms)
    context:     query_id, target, live_listings

    A document has a bounded number of candidate terms (20 demanded, 14 recommended),
    so the per-document windows are small.
    """
    key = ["doc_id", "query_id", "term"]
    cand = proofs.join(existing.select(*key, F.col("share").alias("e_share"), F.col("signal_source").alias("e_source")), key, "full")
    cand = cand.join(demand.select("query_id", "term", F.col("share").alias("d_share"), "live_count", "company_count"), ["query_id", "term"], "left")
    cand = cand.join(recommended.select("query_id", "term", "pos"), ["query_id", "term"], "left").join(evidence, ["query_id", "term"], "left").join(context, ["query_id"])
    c = F.col
    has, covered = F.coalesce(c("has_term"), F.lit(False)), F.coalesce(c("proof") >= c("required"), F.lit(False))
    listed = c("e_source").isNotNull() & ~(has & covered)
    weak_market = c("d_share").isNotNull() & has & ~covered & ~((c("d_share") < 4.0) & (c("live_count") < 2) & (c("company_count") < 2))
    backed = c("pos").isNotNull() & ~covered & c("n_companies").isNotNull()
    modelled = c("pos").isNotNull() & ~covered & ~has
    per_company = F.greatest(F.lit(4.5), F.least(F.lit(18.0), c("n_companies") / F.greatest(c("live_listings"), F.lit(1)) * 100))
    market = F.when(F.coalesce(c("d_share"), F.lit(0.0)) > 0, c("d_share"))
    source = F.when(listed, c("e_source")).when(weak_market, "weak-resume-proof").when(backed, F.when(has, "weak-resume-proof").otherwise("live-support")).when(modelled, "role-family")
    share = (
        F.when(listed, c("e_share")).when(weak_market, c("d_share")).when(backed, F.round(F.coalesce(market, per_company), 1))
        .when(modelled, F.round(F.greatest(F.lit(3.5), F.lit(9.5) - (c("pos") - 1) * 0.8), 1))
    )
    rows = cand.withColumns({"signal_source": source, "gap_share": share}).filter(c("signal_source").isNotNull())
    own = Window.partitionBy("doc_id", "query_id")
    rows = rows.withColumns(
        {
            "n_firm": F.count_if(c("signal_source") != "role-family").over(own),
            "model_no": F.row_number().over(Window.partitionBy("doc_id", "query_id", c("signal_source") == "role-family").orderBy("pos", "term")),
        }
    ).filter((c("signal_source") != "role-family") | (c("model_no") <= c("target") - c("n_firm")))
    rows = rows.withColumn("priority", F.try_element_at(T.lit_map(SIGNAL_PRIORITY), c("signal_source")))
    top = top_per_group(rows, ["doc_id", "query_id"], [F.desc("priority"), F.desc("gap_share"), F.asc("term")], limit, "position")
    return top.select(*key, c("gap_share").alias("share"), "signal_source", F.coalesce(c("has_term"), F.lit(False)).alias("has_term"), "position")


def gap_target(family: Column, domain: Column) -> Column:
    return F.when(family.isin(*X.WIDE_GAP_FAMILIES), 6).when(family.isin(*X.DENSE_FAMILIES) | domain.isin(*X.DENSE_DOMAINS), 5).otherwise(4)


def split_missing_weak(gaps: DataFrame, doc_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, weak): terms the document does not have, and terms it has without enough proof; one row per term."""
    once = cut_lineage(first_per_key(gaps, ["doc_id", "query_id", "term"], [F.asc("position")]))  # both lists read it
    own = doc_terms.select("doc_id", "term").distinct()
    weak = once.join(own, ["doc_id", "term"], "left_semi").withColumn("signal_source", F.lit("weak-resume-proof"))
    missing = once.join(own, ["doc_id", "term"], "left_anti")
    renamed = F.when(F.col("signal_source") == "weak-resume-proof", "live").otherwise(F.col("signal_source"))
    return missing.withColumn("signal_source", renamed), weak


def document_evidence_order() -> list[Column]:
    """Best document evidence first: section, action and number words, no links; longer up to 220 characters."""
    priority = F.coalesce(F.try_element_at(T.lit_map(X.EVIDENCE_PRIORITY), F.col("section")), F.lit(0))
    text = F.col("snippet")
    score = priority + F.when(text.rlike(ACTION_CONTEXT), 2).otherwise(0) + F.when(text.rlike(r"(?U)\b\d[\d,]*\b|%"), 1).otherwise(0)
    score = score - F.when(T.contains_any(F.lower(text), ("http", "linkedin", "github", "@")), 4).otherwise(0)
    return [F.desc(score), F.desc(F.least(F.length(text), F.lit(220))), F.asc(F.length(text)), F.asc(text)]


def listing_evidence_order() -> list[Column]:
    text, live = F.col("snippet"), F.col("source") != X.BASELINE_SOURCE
    score = F.when(live, 4).otherwise(0) + F.when(text.rlike(REQUIREMENT_LANGUAGE), 2).otherwise(0) - F.when(F.contains(F.lower(text), F.lit("typical market expectations")), 1).otherwise(0)
    return [F.desc(score), F.desc(F.least(F.length(text), F.lit(220))), F.asc(F.length(text)), F.asc(text), F.asc("listing_id")]


def term_report(rows: DataFrame, doc_evidence: DataFrame, listing_evidence: DataFrame, per_term: int = 2) -> DataFrame:
    """Report rows (doc_id, query_id, term, kind, share) with their best evidence and main source.

    doc_evidence: doc_id, term, section, snippet; listing_evidence: query_id, term, listing_id, source, snippet.
    Evidence is cut to ``per_term`` before it is collected; baseline evidence is shown only
    where a term has no live evidence.
    """
    own = top_per_group(doc_evidence.distinct(), ["doc_id", "term"], document_evidence_order(), per_term, "r")
    own = own.groupBy("doc_id", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "snippet"))), lambda x: x["snippet"]).alias("document_evidence"))
    has_live = listing_evidence.groupBy("query_id", "term").agg(F.max(F.col("source") != X.BASELINE_SOURCE).alias("has_live"))
    shown = listing_evidence.join(has_live, ["query_id", "term"]).filter(~F.col("has_live") | (F.col("source") != X.BASELINE_SOURCE)).drop("has_live")
    top = top_per_group(shown, ["query_id", "term"], listing_evidence_order(), per_term, "r")
    market = top.groupBy("query_id", "term").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "snippet"))), lambda x: x["snippet"]).alias("listing_evidence"), F.min_by("source", "r").alias("primary_source")
    )
    joined = rows.join(own, ["doc_id", "term"], "left").join(market, ["query_id", "term"], "left")
    return joined.withColumn("primary_source", F.coalesce("primary_source", F.lit("unknown")))


def bucket_gap_report(detail: DataFrame, legacy: DataFrame, limit: int = 8) -> DataFrame:
    """Gap rows merged from detail and plain rows, in buckets live, calibrated and unsupported; top ``limit``.

    detail: doc_id, term, share, primary_source; legacy: doc_id, term, share.
    """
    extra = legacy.join(detail.select("doc_id", "term"), ["doc_id", "term"], "left_anti").withColumn("primary_source", F.lit("unknown"))
    merged = detail.select("doc_id", "term", "share", F.coalesce(F.nullif("primary_source", F.lit("")), F.lit("unknown")).alias("primary_source"), F.lit(0).alias("origin")).unionByName(
        extra.select("doc_id", "term", "share", "primary_source", F.lit(1).alias("origin"))
    )
    src = F.col("primary_source")
    bucket = F.when(src == X.BASELINE_SOURCE, "calibrated").when(src == "unknown", "unsupported").otherwise("live")
    standing = F.when(src == X.BASELINE_SOURCE, 0).when(src == "unknown", 1).otherwise(2)
    marked = merged.withColumns({"bucket": bucket, "standing": F.when(F.col("origin") == 0, standing).otherwise(-1)})
    return top_per_group(marked, ["doc_id"], [F.desc("standing"), F.desc("share"), F.asc("term")], limit, "position").drop("standing", "origin")
