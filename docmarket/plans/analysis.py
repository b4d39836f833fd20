"""End-to-end plans: score documents, analyse documents against a market."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators import (
    alignment as G, dedupe as D, gaps as L, guards as H, market as K, quality as Q, requirements as RQ, scoring as M, select as J, structure as C, taxonomy as R,
    temporal, terms as E,
)
from docmarket.roles import RoleLexicon
from docmarket.session import cut_lineage

def score_documents(docs: DataFrame, doc_id: str, text: str, headers: C.Headers, as_of: Column) -> DataFrame:
    """Signals, years, archetype, parser confidence, quality and ATS score of each document."""
    parsed = C.parse_documents(docs, doc_id, text, headers)
    signals = C.parse_signals(docs, doc_id, text, headers, parsed=parsed)
    years = temporal.experience_years(C.part_sections(parsed, doc_id), doc_id, as_of)
    body = F.col(text)
    contact = T.extract_contact(body)
    own = docs.select(
        doc_id, *[c.alias(n) for n, c in {**Q.text_flags(body), **Q.text_evidence(body)}.items()], Q.repetition_penalty(body).alias("repetition"),
        (contact["email"] != "").alias("has_email"), (contact["phone"] != "").alias("has_phone"), F.lower("content_type").alias("content_type"),
    )
    wide = signals.join(own, [doc_id]).join(years, [doc_id], "left").fillna(0.0, ["experience_years"])
    for name in ("summary", "experience", "projects", "education", "skills", "research", "publications", "teaching", "awards"):
        wide = wide.withColumn(f"has_{name}", F.coalesce(F.array_contains("section_names", name), F.lit(False)))
    wide = wide.withColumn("a", Q.classify_archetype()).withColumns({"archetype": F.col("a.archetype"), "archetype_confidence": F.col("a.confidence")}).drop("a")
    return wide.withColumns({"parser_confidence": Q.parser_confidence(), "resume_quality": Q.document_quality(), "ats_compliance": Q.ats_compliance()})


class Market(NamedTuple):
    """The listings' side of a run, without the documents."""

    terms: DataFrame  # listing_id, term, weight, n
    selected: DataFrame  # query_id, position, key, ...
    ranked: DataFrame  # candidates of all queries, scored
    chosen: DataFrame  # query_id, listing_id, position
    own_terms: DataFrame  # terms of the chosen listings
    demand: DataFrame  # query_id, term, share, ...: not written out yet


class Analysis(NamedTuple):
    """The tables of one run; all lazy."""

    selected: DataFrame  # query_id, position, key, ...: listings chosen per query
    demand: DataFrame  # query_id, term, share, ...: pruned market demand
    scores: DataFrame  # doc_id, query_id, six components, overall_score
    gaps: DataFrame  # doc_id, query_id, term, share, signal_source


def listing_terms(listings: DataFrame, lexicon: DataFrame, req: RQ.RequirementLexicon) -> DataFrame:
    """(listing_id, term, weight, n): requirement profile of each listing from lexicon hits in its sentences."""
    rows = RQ.sentences(listings, ["listing_id", "title"], F.concat_ws(". ", "title", "description"), req)
    hits = E.term_hits(rows, ["listing_id", "title", "sent_no", "sentence"], F.col("sentence"), lexicon).dropDuplicates(["listing_id", "sent_no", "term"])
    # Small and read twice below; the texts are searched once.
    found = cut_lineage(RQ.pattern_weights(hits.withColumnRenamed("sentence", "snippet"), "listing_id", req).withColumn("extracted", F.lit(True)))
    counts = found.select("listing_id", "term", "n")
    return RQ.requirement_profile(found, listings, "listing_id", "title").join(counts, ["listing_id", "term"])


def guard_inputs(annotated: DataFrame, flags: DataFrame, roles: RoleLexicon) -> DataFrame:
    """Annotated candidates with the query and title flags the guards read."""
    c = F.col
    negative = F.exists("q_negative", lambda h: T.contains_phrase(c("t_text"), h))
    asked = F.arrays_overlap(F.split(T.clean_label(c("q_text")), " "), T.lit_array(("manager", "director", "head", "chief", "vp", "vice", "president")))
    df = annotated.join(flags.withColumnRenamed("label", "q_text"), ["q_text"]).withColumns({**G.context_signals({n: c(n) for n in ("desc_words", "all_words")}), "negative_hit": negative})
    df = df.drop("desc_words", "all_words")
    return df.withColumns(
        {
            "alignment": R.role_alignment(c("q_role"), c("t_role"), c("q_domain"), c("t_domain"), c("negative_hit"), roles), "hard_mismatch": G.location_mismatch(c("q_location"), c("location_tier")),
            "finance_mismatch": H.finance_mismatch(c("t_text"), c("q_role")), "web_mismatch": H.web_mismatch(c("t_text"), c("q_role")), "security_title": H.security_title(c("t_text")),
            "head_overlap": F.arrays_overlap("q_heads", "t_heads"), "has_specialty": F.size("q_specialty") > 0, "abstract_role": c("q_role").isin(*X.ABSTRACT_FAMILIES),
            "leadership_clash": ~asked & c("t_text").rlike(r"\b(manager|director|head|chief|vp|vice president)\b"), "excluded_title": F.coalesce(c("q_domain") == "data", F.lit(False)) & c("t_text").rlike(r"\bdata entry\b|\bentry operator\b"),
            "family_title_ok": F.lit(True), "weak_software": c("q_role").isin("frontend developer", "mobile developer", "embedded engineer"), "has_market": F.size("q_market") > 0, "has_primary": F.size("q_primary") > 0,
            "other_known_role": c("t_role").isin(*roles.families) & (c("t_role") != c("q_role")) & (F.size("q_primary") > 0), "penalty": G.unrequested_title_penalty(),
            "focused_location": F.when(G.is_country_focused(c("q_location")), c("location_score")).otherwise(0.0),
        }
    )


def search_listings(listings: DataFrame, queries: DataFrame, terms: DataFrame, roles: RoleLexicon, candidate_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, candidates): candidates scored and gated per query, then selected under the diversity caps.

    listings: query_id, listing_id, source, company, title, description, tags, location, remote
    queries: query_id, q_text, q_location, limit; terms: listing_id, term, weight
    """
    labels = R.distinct_labels(listings.select(F.col("title").alias("label")).unionByName(queries.select(F.col("q_text").alias("label"))), "label")
    profiles = cut_lineage(R.role_hints(R.role_profile(labels, roles), roles))
    flags = R.query_class(profiles.withColumn("variations", T.lit_array([])), roles, X.FAMILY_GROUPS, X.DENSE_GROUPS, X.ABSTRACT_FAMILIES, X.BUSINESS_DOMAINS)
    # A listing has at most as many terms as the lexicon.
    own = terms.groupBy("listing_id").agg(F.sort_array(F.collect_list("term")).alias("terms"), F.round(F.avg("weight") * 100, 1).alias("requirement_quality"))
    rows = listings.join(own, ["listing_id"], "left").withColumns({"terms": F.coalesce("terms", T.lit_array([])), "requirement_quality": F.coalesce("requirement_quality", F.lit(0.0))})
    adjacent = [f"{a}|{b}" for a, bs in roles.adjacent.items() for b in bs]
    # Much work on each row, and often one split: listings come from one file, and joins with small tables keep its splits.
    # One task a core, as each takes seconds to set up these expressions; rows pass through one by one.
    cores = listings.sparkSession.sparkContext.defaultParallelism
    pairs = G.candidates(rows, queries, profiles, profiles).repartition(cores, "query_id", "listing_id")
    scored = G.annotate(pairs, roles.families, adjacent)
    # Guards read each score dozens of times. Written out once, the scores are plain columns
    # for them; left in the plan, every guard would carry all text expressions again.
    guarded = H.with_guard_columns(cut_lineage(guard_inputs(scored, flags, roles)))
    kept = H.relevant_or_relaxed(guarded, H.quality_gate(), "listing_id")
    ranked = J.rank_candidates(kept, "listing_id", candidate_limit)
    c = F.col
    safe = ~c("hard_mismatch") & c("g_final")
    exact = (c("alignment") >= 2) & (c("precision") >= 2)
    related = (c("alignment") >= 0) & ((c("title_overlap") >= 1) | (c("precision") >= 2) | (c("family_overlap") >= 2))
    floors = R.live_floors(c("sparse"), c("dense"), c("limit"))
    ranked = ranked.withColumns({n: e.cast("int") for n, e in floors.items()})
    ranked = ranked.withColumns(
        {
            "is_strong": H.live_candidate(True) & safe, "is_secondary": H.live_candidate(False) & safe, "is_family": H.family_candidate() & safe, "is_recovery": c("g_recovery") & safe, "is_related": related & safe,
            "is_last_resort": (c("alignment") >= 0) & (c("market_quality") >= 18) & safe, "key": c("listing_id"), "title_key": T.clean_label(c("title")), "signature": D.near_signature(c("company"), c("title"), c("description")),
            "source_cap": J.source_cap(c("source"), c("live_target"), F.lit(4), c("limit")), "title_cap_low": F.when(exact, 2).otherwise(1), "title_cap": F.lit(1), "similar_ok_low": exact, "similar_ok": exact,
        }
    )
    ranked = cut_lineage(ranked)
    targets = ranked.select("query_id", "live_target", "display_floor").distinct()
    return cut_lineage(J.select_diverse(ranked, targets)), ranked


def analyse_market(listings: DataFrame, queries: DataFrame, lexicon: DataFrame, roles: RoleLexicon, req: RQ.RequirementLexicon = RQ.RequirementLexicon()) -> Market:
    """Selected listings and the demand for terms among them."""
    terms = cut_lineage(listing_terms(listings, lexicon, req))
    selected, ranked = search_listings(listings, queries, terms, roles)
    chosen = selected.select("query_id", F.col("key").alias("listing_id"), "position")
    pool = ranked.join(chosen, ["query_id", "listing_id"])
    signed = pool.withColumn("signature", D.listing_signature(F.col("source"), F.col("company"), F.col("title"), F.col("description")))
    market = signed.select("query_id", "listing_id", "source", "company", "title", "role_fit", "listing_quality", "signature")
    own_terms = terms.select("listing_id", "term", "weight", F.col("n").alias("n_evidence")).join(chosen, ["listing_id"]).drop("position")
    hint_rows = ranked.select("query_id", "q_primary", "q_market").distinct()
    both = F.concat(F.transform("q_primary", lambda t: F.struct(t.alias("term"), F.lit("primary").alias("kind"))), F.transform("q_market", lambda t: F.struct(t.alias("term"), F.lit("market").alias("kind"))))
    hints = T.explode_once(hint_rows, ["query_id"], both, "h").select("query_id", "h.term", "h.kind")
    demand = K.prune_demand(K.term_demand(market, own_terms, hints), lexicon.select("term").distinct())
    return Market(terms, selected, ranked, chosen, own_terms, demand)


def run_analysis(
    docs: DataFrame, listings: DataFrame, queries: DataFrame, lexicon: DataFrame, roles: RoleLexicon, headers: C.Headers, as_of: Column, req: RQ.RequirementLexicon = RQ.RequirementLexicon(), mode: str = "full",
) -> Analysis:
    """Documents against the market of their query.

    docs: doc_id, query_id, text, content_type. ``mode="light"`` uses the mean proof as skill
    match. Shuffles: document aggregates by doc_id, duplicates by signature, demand by (query,
    term), pairs by query; a document meets only the few listings selected for its query.
    """
    _, selected, ranked, chosen, own_terms, demand = analyse_market(listings, queries, lexicon, roles, req)
    demand = cut_lineage(demand)

    signals = cut_lineage(score_documents(docs, "doc_id", "text", headers, as_of).drop("parser_confidence"))
    sections = C.assign_sections(docs, "doc_id", "text", headers)
    hits = cut_lineage(E.term_hits(sections, ["doc_id", "section"], F.col("text"), lexicon).select("doc_id", "section", "term").distinct())
    doc_terms, support = hits.select("doc_id", "term").distinct(), E.section_support(hits, "doc_id")
    flags = ranked.select("query_id", "dense").distinct()
    wanted = docs.select("doc_id", "query_id").join(demand.drop("rank"), ["query_id"]).join(signals.select("doc_id", "experience_years"), ["doc_id"]).join(flags, ["query_id"])
    need = L.required_proof(*[F.col(n) for n in ("primary", "hinted", "share", "live_count", "company_count", "live_listings", "dense", "experience_years")])
    proved = E.with_proof(wanted, doc_terms, support, "doc_id").withColumns({"required": need, "has_term": F.col("proof") > 0})
    proved = cut_lineage(proved)
    matched, missing = L.split_matched(proved)

    body = listings.select("query_id", "listing_id", "title", "description", "source")
    pairs = docs.select("doc_id", "query_id", "text").join(chosen, ["query_id"]).join(body, ["query_id", "listing_id"])
    pairs = pairs.join(ranked.select("query_id", "listing_id", "title_alignment", "role_fit"), ["query_id", "listing_id"])
    pairs = pairs.withColumns({"base": M.token_overlap(F.col("text"), F.concat_ws(" ", "title", "description")), "language": F.lit(0.0)})
    relevance = M.semantic_relevance(pairs, own_terms, proved.select("doc_id", "term", "proof"), doc_terms)
    first = pairs.select("doc_id", "listing_id", F.col("position").alias("rank"))
    semantic = M.semantic_match(relevance, first, 5) if mode == "full" else M.semantic_match(relevance)
    spread = pairs.select("doc_id", "listing_id", "source").join(own_terms.select("listing_id", "term", "weight").distinct(), ["listing_id"]).join(proved.select("doc_id", "term", "proof"), ["doc_id", "term"], "left").fillna(0.0, ["proof"])
    skill = M.skill_match(spread) if mode == "full" else M.simple_skill_match(proved)
    years = M.mean_required_years(body.join(chosen, ["query_id", "listing_id"], "left_semi"))
    counts = matched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matched"))
    out = docs.select("doc_id", "query_id").join(signals.select("doc_id", "experience_years", "archetype", "resume_quality", "ats_compliance"), ["doc_id"])
    for part in (skill, semantic, M.demand_coverage(proved), counts):
        out = out.join(part, ["doc_id"], "left")
    out = out.join(years, ["query_id"], "left").fillna(0.0, ["skill_match", "semantic_match", "market_demand"]).fillna(0, ["n_matched"])
    out = out.withColumn("experience_match", M.experience_match(F.col("experience_years"), F.col("target_years")))
    overall = M.overall_score(F.col("n_matched") > 0, {n: F.col(n) for n in D.COMPONENTS})
    scores = out.select("doc_id", "query_id", "archetype", *D.COMPONENTS, "n_matched", overall.alias("overall_score"))
    return Analysis(selected, demand, scores, missing.select("doc_id", "query_id", "term", "share", "signal_source"))
