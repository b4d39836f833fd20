"""Guards: boolean columns over the scores of a candidate row; all map to ``df.filter``.

Query flags: q_domain, strict, needs_specialty, has_specialty, business, sparse, abstract_role
Title flags: negative_hit, finance_mismatch, web_mismatch, head_overlap, hard_mismatch,
  family_title_ok, leadership_clash, excluded_title, security_title, weak_software
Scores: alignment, precision, title_overlap, family_overlap, core_title, core_text, specialty_overlap,
  domain_score, skill_overlap, role_fit, market_quality, listing_quality, requirement_quality,
  title_alignment, location_score, skill_count, hint_overlap, primary_overlap, title_hint_hits, primary_hits, market_hits

Guards build on each other, so the shared ones are added as columns once by
:func:`with_guard_columns`; the functions below it read those columns. Nesting the
expressions instead would outgrow the code generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators.ranking import top_per_group

c = F.col

# --- fixed values -------------------------------------------------------------
RELAXED_ROWS, RELAXED_FIT = 5, 6.0
FINANCE_ANALYSTS = (
    "business finance analyst", "budget analyst", "financial analyst", "finance analyst", "fp a analyst", "fpa analyst", "investment analyst",
    "pricing analyst", "revenue analyst", "treasury analyst",
)
FINANCE_OTHERS = r"\b(accountant|accounting|accounts payable|accounts receivable|bookkeeper|payroll|tax)\b"
FINANCE_WORDS = r"\b(finance|financial|treasury|revenue|budget|investment)\b"
MOBILE_WORDS, WEB_WORDS = ("ios", "android", "mobile", "swift", "kotlin", "flutter"), ("react", "frontend", "web", "javascript", "typescript", "ui")
SECURITY_BLOCKED = r"\b(account executive|sales|marketing|product marketing|counsel|legal|driver|treasury)\b"
SECURITY_SIGNS = (
    "application security", "cloud security", "cyber", "cybersecurity", "detection", "grc", "iam", "identity", "incident response",
    "information security", "privacy", "security", "soc", "threat", "trust", "vulnerability",
)
SECURITY_ROLES = r"\b(analyst|architect|consultant|director|engineer|hunter|lead|manager|operator|researcher|responder|specialist|tester)\b"
DENSE_FEEDS, OPEN_FEEDS = ("themuse", "jobicy"), ("remotive", "remoteok", "arbeitnow")
# ------------------------------------------------------------------------------


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _in_domain(*names: str) -> Column:
    return F.coalesce(c("q_domain").isin(*names), F.lit(False))


GUARD_COLUMNS = ("g_lacks", "g_explicit", "g_context", "g_bridge", "g_recovery", "g_final")


def with_guard_columns(cand: DataFrame) -> DataFrame:
    """Candidate rows with the guards that other guards use."""
    out = cand.withColumn("g_lacks", c("needs_specialty") & (c("specialty_overlap") == 0))
    out = out.withColumns({"g_explicit": explicit_alignment(), "g_context": contextual_recovery(), "g_bridge": family_bridge(), "g_recovery": domain_recovery()})
    return out.withColumn("g_final", final_guard())


def lacks_specialty() -> Column:
    return c("g_lacks")


def _bound(test, *columns: str) -> Column:
    """``test`` over guard columns that are computed once, however often the test reads them."""
    return T.let(F.struct(*columns), test)


def finance_mismatch(title: Column, q_role: Column) -> Column:
    """A finance query against an accountant title, or a finance title that names no analyst."""
    def test(t: Column) -> Column:
        accepted = F.exists(T.lit_array(FINANCE_ANALYSTS), lambda p: T.contains_clean(t, p))
        loose = t.rlike(FINANCE_WORDS) & ~t.rlike(r"\banalyst\b")
        return (q_role == "financial analyst") & (t != "") & ~accepted & (t.rlike(FINANCE_OTHERS) | loose)

    return T.let(T.clean_words(title), test)


def web_mismatch(title: Column, q_role: Column) -> Column:
    """A web role against a title that only names mobile work."""
    return q_role.isin("frontend developer", "full stack developer") & T.contains_any(title, MOBILE_WORDS) & ~T.contains_any(title, WEB_WORDS)


def security_title(title: Column) -> Column:
    """Title with a security word and a role word and no sales or legal word."""
    return T.let(
        T.clean_words(title), lambda t: (t != "") & ~t.rlike(SECURITY_BLOCKED) & t.rlike(SECURITY_ROLES) & F.exists(T.lit_array(SECURITY_SIGNS), lambda s: T.contains_clean(t, s))
    )


def explicit_alignment() -> Column:
    named = (
        (c("title_overlap") >= 1) | ((c("family_overlap") >= 2) & (c("core_title") >= 1)) | (c("precision") >= 1) | (c("core_text") >= 2)
    )
    return ~c("negative_hit") & ~lacks_specialty() & (c("alignment") >= 0) & named


def _business_title(explicit: Column) -> Column:
    return (c("title_overlap") >= 1) | (c("precision") >= 1) | explicit | ((c("domain_score") >= 2) & ((c("core_title") >= 1) | (c("family_overlap") >= 1)))


def quality_gate() -> Column:
    """Is a listing good and relevant enough to be shown for the query."""
    explicit = c("g_explicit")
    rejected = _any(c("hard_mismatch"), c("negative_hit"), (c("alignment") < 0) & (c("title_overlap") == 0) & (c("core_title") == 0), c("title_alignment") <= -6.0)
    business = c("business") & _business_title(explicit)
    business_ok = (c("requirement_quality") >= 8.0) | (c("listing_quality") >= 4.0) | (c("role_fit") >= 0.3)
    thin_sparse = c("sparse") & (((c("skill_overlap") < 1.0) & (c("precision") < 2)) | ((c("requirement_quality") < 18.0) & (c("role_fit") < 2.5)))
    open_feed = c("source").isin(*OPEN_FEEDS) & (c("role_fit") >= 5.0) & explicit
    weak = _any(
        ~explicit & (c("title_overlap") + c("family_overlap") + c("domain_score") == 0), (c("precision") <= 0) & (c("domain_score") < 2),
        (c("listing_quality") < 4.5) & ~explicit, c("role_fit") < 2.0, c("other_known_role") & (c("role_fit") < 4.5),
        c("has_market") & (((c("hint_overlap") == 0) & (c("role_fit") < 6.5)) | ((c("hint_overlap") == 1) & (c("skill_count") <= 2))),
        c("has_primary") & (c("primary_overlap") == 0) & (c("role_fit") < 9.0),
        (c("title_overlap") == 0) & (c("core_title") == 0) & (c("family_overlap") == 0) & (c("domain_score") < 2) & (c("skill_overlap") < 1.5),
    )
    enough = (c("requirement_quality") >= 22.0) | (c("listing_quality") >= 8.0) | (c("skill_count") >= 3) | (c("role_fit") >= 4.5)
    return F.when(rejected, False).when(business, business_ok).when(thin_sparse, False).when(open_feed, True).when(weak, False).otherwise(enough)


def relevant_or_relaxed(cand: DataFrame, gate: Column, tie: str) -> DataFrame:
    """Rows that pass the gate; for queries where none does, the best five with a high fit."""
    flagged = cand.withColumn("__pass", gate)
    served = flagged.filter("__pass").select("query_id").distinct()
    spare = flagged.join(served, ["query_id"], "left_anti").filter((c("role_fit") >= RELAXED_FIT) & ~c("hard_mismatch"))
    spare = top_per_group(spare, ["query_id"], [F.desc("location_score"), F.desc("market_quality"), F.asc(tie)], RELAXED_ROWS)
    return flagged.filter("__pass").unionByName(spare).drop("__pass")


def positively_aligned_or_all(cand: DataFrame, score: str, limit: int) -> DataFrame:
    """Rows with a positive score where a query has enough of them, else all its rows."""
    need = max(4, min(limit, 6))
    rich = cand.groupBy("query_id").agg(F.count_if(c(score) > 0).alias("n")).filter(c("n") >= need).select("query_id", F.lit(True).alias("__rich"))
    return cand.join(rich, ["query_id"], "left").filter(c("__rich").isNull() | (c(score) > 0)).drop("__rich")


def family_bridge() -> Column:
    """A same-family listing worth keeping though its title is worded differently."""
    special, head, dom = c("specialty_overlap") >= 1, c("head_overlap"), c("domain_score") >= 2
    blocked = _any(c("alignment") < 1, c("web_mismatch"), lacks_specialty(), c("role_fit") < 1.5)
    data_strict = _in_domain("data") & c("strict")
    data_ok = (c("core_title") >= 1) & (special | (c("family_overlap") >= 1) | dom | (c("role_fit") >= 3.0))
    adjacent = (c("alignment") == 1) & head & ((c("family_overlap") >= 1) | dom)
    return (
        F.when(blocked, False).when((c("precision") >= 1) | (c("title_overlap") >= 1), True)
        .when(c("has_specialty") & special & ~head & (c("precision") <= 0), False).when(data_strict, data_ok)
        .when((c("alignment") >= 3) & head & dom, True).when(special & (head | (c("family_overlap") >= 1)) & dom, True)
        .when(adjacent, (c("core_title") >= 1) | (c("role_fit") >= 2.0)).when(c("abstract_role") & dom, (c("family_overlap") >= 1) | (c("role_fit") >= 2.5)).otherwise(False)
    )


def domain_recovery() -> Column:
    """Security listings that the wording checks would miss."""
    lost = (c("alignment") < 0) & (c("title_overlap") == 0) & (c("domain_score") < 2)
    kept = (c("domain_score") >= 2) & ((c("title_overlap") >= 1) | (c("role_fit") >= 3.0) | (c("market_quality") >= 90.0))
    return _in_domain("security") & c("security_title") & ~lost & kept


def contextual_recovery() -> Column:
    """Listings whose text carries the role though the title does not name it."""
    hits = c("title_hint_hits") + c("primary_hits") * 2 + F.least(c("market_hits"), F.lit(4))
    dom, head = c("domain_score") >= 2, c("head_overlap")
    tied = (c("family_overlap") >= 1) | (c("core_title") >= 1) | dom | head
    untitled = (c("title_overlap") == 0) & (c("core_title") == 0)
    data_blind = ((c("market_hits") >= 5) | (c("skill_overlap") >= 8.0)) & (c("role_fit") >= 2.0) & ((c("family_overlap") >= 1) | dom | head)
    data_named = ((c("primary_hits") >= 3) | (c("market_hits") >= 4) | (c("skill_overlap") >= 5.0)) & (c("role_fit") >= 2.0) & tied
    technical = (hits >= 3) & (c("role_fit") >= 1.75) & tied
    return (
        F.when(lacks_specialty() | c("q_domain").isNull(), False).when((c("precision") >= 1) | (c("title_overlap") >= 1), True)
        .when((c("alignment") < 0) & (c("core_title") < 2), False).when(c("q_domain") == "data", F.when(untitled, data_blind).otherwise(data_named))
        .when(c("q_domain").isin("software", "security", "infra"), technical).otherwise((hits >= 3) & (c("role_fit") >= 2.0) & tied)
    )


def final_guard() -> Column:
    """Last check before a listing is shown."""

    def test(g: Column) -> Column:
        ctx = g["g_context"]
        untitled = (c("precision") <= 0) & (c("title_overlap") == 0)
        software_gap = _in_domain("software", "security") & untitled & (c("family_overlap") == 0)
        recovered = _in_domain("software") & c("weak_software") & (c("alignment") >= 1) & (c("specialty_overlap") >= 1) & (c("role_fit") >= 3.0) & ctx
        data = _in_domain("data")
        blocked = _any(
            ~c("family_title_ok"), c("strict") & (c("leadership_clash") | c("excluded_title")), software_gap & ~recovered,
            c("strict") & untitled & (c("core_title") == 0) & ~ctx, c("strict") & (c("alignment") == 1) & untitled & ~ctx,
            data & untitled & (c("family_overlap") == 0) & (c("core_title") == 0) & ~ctx & (c("role_fit") < 3.5), data & (c("alignment") < 0) & untitled,
            (c("role_fit") < 1.0) & (c("precision") <= 0) & (c("core_title") == 0),
        )
        return F.when((c("alignment") <= -3) | g["g_lacks"] | c("finance_mismatch"), False).when(g["g_bridge"] | g["g_recovery"], True).otherwise(~blocked)

    return _bound(test, "g_lacks", "g_context", "g_bridge", "g_recovery")


def precise_query_guard() -> Column:
    """Does the listing name what the query literally asks for."""
    strict_ok = _any(
        c("raw_phrase_hit"), c("multi_word_hint"), (c("n_raw_tokens") >= 2) & (c("raw_title_hits") >= 2), (c("precision") >= 2) & ((c("core_title") >= 2) | (c("family_overlap") >= 2))
    )
    loose_ok = _any(c("raw_phrase_hit"), c("raw_hits") >= 1, c("title_overlap") >= 1, c("precision") >= 2, (c("skill_overlap") >= 1.5) & (c("domain_score") >= 2))
    return F.when(c("n_raw_tokens") == 0, True).when(lacks_specialty() | c("web_mismatch"), False).when(c("strict"), strict_ok).otherwise(loose_ok)


def _candidate_rejected() -> Column:
    low = c("alignment") < 0
    return _any(
        c("hard_mismatch"), lacks_specialty(), c("finance_mismatch"), low & (c("title_overlap") == 0) & (c("core_title") == 0),
        low & (c("precision") <= 0) & (c("title_overlap") == 0), c("title_alignment") <= -6.0,
    )


def live_candidate(strict: bool) -> Column:
    """Strong (strict) or secondary candidate for selection."""
    explicit = c("g_explicit")
    t, f, k, s, fit, mq, dom, p = (c(n) for n in ("title_overlap", "family_overlap", "core_title", "skill_overlap", "role_fit", "market_quality", "domain_score", "precision"))
    business = c("business") & (c("alignment") >= 0) & _business_title(explicit) & (c("location_score") > 0.0)
    business_ok = (mq >= 10.0) | (fit >= 0.4) | (c("title_alignment") >= 8.0) if strict else (mq >= 8.0) | (fit >= 0.2) | (c("title_alignment") >= 5.0)
    lost_data = _in_domain("data") & ~explicit & (p <= 0) & (t == 0) & (k == 0) & (f == 0) & (fit < 3.25)
    lost_tech = _in_domain("software", "security") & (p <= 0) & (t == 0) & (f == 0)
    untitled = (p <= 0) & (t == 0) & (f == 0)
    if strict:
        sparse_ok = ((s >= 1.0) & ((p >= 1) | (f >= 1) | explicit)) | ((t >= 1) & (mq >= 36.0) & (fit >= 1.0))
        weak = _any(c("location_score") < 0.2, ~explicit & (mq < 48.0), (p <= 0) & (dom < 2) & ~explicit)
        good = _any(
            c("source").isin(*DENSE_FEEDS) & (dom >= 2) & ((t >= 1) | (f >= 1) | ((s >= 1.5) & (k >= 1))), (k >= 1) & (s >= 1.0),
            c("source").isin(*DENSE_FEEDS) & ((t >= 1) | (f >= 2)) & (mq >= 18.0), (t >= 1) & ((fit >= 1.0) | (s >= 1.0)),
            (dom >= 2) & (s >= 1.5) & ((p >= 1) | (t >= 1) | (f >= 1) | (k >= 1)), (f >= 2) & (fit >= 3.0) & (s >= 1.0),
            (t == 0) & (fit >= 6.0) & (s >= 2.0) & (mq >= 40.0), c("source").isin(*OPEN_FEEDS) & (t >= 1) & (mq >= 28.0),
        )
    else:
        sparse_ok = ((s >= 1.0) & (dom >= 1) & ((p >= 1) | (f >= 1))) | ((t >= 1) & (mq >= 30.0) & (fit >= 1.0))
        weak = _any(c("location_score") <= 0.0, ~explicit & (mq < 40.0), (p <= 0) & (dom < 2) & ~explicit)
        good = _any(
            c("source").isin(*DENSE_FEEDS) & ((dom >= 2) | (t >= 1) | (f >= 2)), (k >= 1) & ((s >= 1.0) | (fit >= 2.0)), (t >= 1) & (fit >= 0.5),
            (dom >= 2) & ((s >= 1.0) | (fit >= 1.5)), (f >= 2) & (fit >= 2.5), (t == 0) & (s >= 2.0) & (fit >= 3.25), (mq >= 42.0) & (t >= 1),
        )
    return (
        F.when(_candidate_rejected(), False).when(business, business_ok).when(lost_data | lost_tech, False)
        .when(c("sparse"), ~untitled & sparse_ok).when(weak, False).otherwise(good)
    )


def family_candidate() -> Column:
    """Candidate through its family although the wording is weak."""
    t, f, k, s, fit, dom, p = (c(n) for n in ("title_overlap", "family_overlap", "core_title", "skill_overlap", "role_fit", "domain_score", "precision"))
    business = c("business") & ((t >= 1) | (p >= 1) | ((dom >= 2) & ((k >= 1) | (f >= 1))))
    lost = _in_domain("data") & (t == 0) & (f == 0) & (p <= 0) & (k == 0) & (fit < 3.25)
    good = _any(
        (dom >= 2) & (s >= 1.0) & ((p >= 1) | (t >= 1) | (f >= 1) | (k >= 1)), (dom >= 1) & (t >= 1), (dom >= 1) & (f >= 2) & (fit >= 2.0),
        (dom >= 1) & (c("market_quality") >= 28.0) & (s >= 1.0) & (p >= 1),
    )
    return F.when(c("hard_mismatch") | lacks_specialty(), False).when(c("g_bridge"), True).when((c("alignment") < 0) & (t == 0), False).when(business, True).when(lost, False).otherwise(good)


def exact_backup_guard() -> Column:
    """Second line for exact queries."""

    def test(g: Column) -> Column:
        ctx, named = g["g_context"], (c("title_overlap") >= 1) | (c("precision") >= 1)
        data_ok = ctx | ((c("core_title") >= 1) & ((c("domain_score") >= 2) | (c("skill_overlap") >= 1.0) | (c("role_fit") >= 3.0)))
        tech_ok = (c("core_title") >= 1) & ((c("domain_score") >= 2) | (c("role_fit") >= 3.0) | (c("family_overlap") >= 1))
        adjacent = c("strict") & (c("alignment") == 1) & (c("precision") <= 0) & (c("title_overlap") == 0) & ~ctx
        return (
            F.when(c("hard_mismatch") | c("finance_mismatch"), False).when(g["g_bridge"] | g["g_recovery"], True).when((c("alignment") < 0) | adjacent | g["g_lacks"], False)
            .when(named, True).when(c("q_domain") == "data", data_ok).when(c("q_domain").isin("software", "security"), tech_ok).otherwise(live_candidate(False))
        )

    return _bound(test, "g_lacks", "g_context", "g_bridge", "g_recovery")


def same_family_recovery_guard() -> Column:
    """Third line for exact queries: same family, past the final guard."""

    def test(g: Column) -> Column:
        ctx, named = g["g_context"], (c("precision") >= 1) | (c("title_overlap") >= 1)
        data = F.when(c("strict") & (c("alignment") == 1) & ~named, ctx).when(named | ctx, True).otherwise(
            (c("alignment") >= 0) & (c("core_title") >= 1) & ((c("family_overlap") >= 1) | (c("domain_score") >= 2) | (c("skill_overlap") >= 1.0) | (c("role_fit") >= 2.5))
        )
        tech = (c("core_title") >= 1) & ((c("family_overlap") >= 1) | (c("skill_overlap") >= 1.0) | (c("role_fit") >= 2.5))
        return (
            F.when(c("hard_mismatch") | ~g["g_final"] | g["g_lacks"], False).when(g["g_bridge"], True).when(c("q_domain") == "data", data)
            .when(((c("alignment") >= 1) & (c("core_title") >= 1)) | named, True).when(c("q_domain").isin("software", "security"), tech).otherwise(family_candidate())
        )

    return _bound(test, "g_lacks", "g_context", "g_bridge", "g_final")


def cache_safe_match() -> Column:
    return (c("alignment") >= 0) & _any(
        c("precision") >= 2, c("title_overlap") >= 1, (c("family_overlap") >= 2) & (c("core_title") >= 1), (c("domain_score") >= 2) & (c("skill_overlap") >= 1.5)
    )
