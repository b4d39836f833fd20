"""Scores of a listing for a query, on candidate rows that hold both sides.

Candidate columns (see :func:`candidates`):
  query:   q_text, q_role, q_domain, q_tokens, q_specialty, q_title_hints, q_negative, q_market, q_primary
  listing: title, t_text (title, with a glued label spelled out), t_role, t_domain, description, tags, terms
Each score is one expression; texts are cleaned once per row and bound before they are
searched, so a candidate costs one pass over its text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators.market import trust
from docmarket.operators.ranking import top_per_group

# --- fixed values -------------------------------------------------------------
FAST_STOPWORDS = ("a", "an", "and", "for", "in", "of", "remote", "the", "to", "with")
FAMILY_FILLERS = ("engineer", "developer", "manager")
LEADERSHIP = ("manager", "director", "head", "chief", "lead", "principal", "staff", "cto")
# ------------------------------------------------------------------------------

c = F.col


def contains_word(hay: Column, needle: Column) -> Column:
    """Cleaned sides; several words as text, one word as a whole word."""
    plus = F.concat(F.lit(r"(?U)\b"), F.replace(needle, F.lit("+"), F.lit(r"\+")), F.lit(r"\b"))
    padded = F.contains(F.concat(F.lit(" "), F.replace(hay, F.lit("+"), F.lit(" ")), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))
    word = F.when(F.instr(needle, "+") > 0, F.regexp_like(hay, plus)).otherwise(padded)
    return F.when(needle == "", F.lit(False)).when(F.instr(needle, " ") > 0, F.contains(hay, needle)).otherwise(word)


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _texts(description: Column, cleaned: Column | None) -> Column:
    tags = F.array_join(F.transform(F.coalesce(c("tags"), T.lit_array([])), T.clean_words), " ")
    return F.struct(
        T.clean_words(c("q_text")).alias("query"), T.clean_words(c("title")).alias("title"), (T.clean_words(description) if cleaned is None else cleaned).alias("desc"), tags.alias("tags"),
        F.transform(c("q_title_hints"), T.clean_words).alias("hints"), F.transform(c("q_negative"), T.clean_words).alias("negative"),
    )


def title_alignment(description: Column | None = None, cleaned: Column | None = None) -> Column:
    """How well title, tags and description name the query's role. ``cleaned`` is the description's words, if they are there already."""
    same, inside = c("q_role") == c("t_role"), F.contains(c("t_role"), c("q_role"))

    def score(x: Column) -> Column:
        title_hits = _count(x["hints"], lambda h: contains_word(x["title"], h))
        desc_hits = _count(x["hints"], lambda h: contains_word(x["desc"], h) | contains_word(x["tags"], h))
        core = _count(c("q_tokens"), lambda t: contains_word(x["title"], t))
        in_tags = _count(c("q_tokens"), lambda t: contains_word(x["tags"], t))

        def total(n: Column) -> Column:
            named = F.when(x["query"] == "", 0.0).when(contains_word(x["title"], x["query"]), 8.0).when(contains_word(x["tags"], x["query"]), 2.5).when(contains_word(x["desc"], x["query"]), 1.5).otherwise(0.0)
            s = F.when(same, 16.0).when(inside, 10.5).otherwise(0.0) + named + F.least(F.lit(10.0), n["t"] * F.lit(3.0)) + F.least(F.lit(4.5), n["d"] * F.lit(1.0))
            s = s + n["core"] * F.lit(2.5) + n["tags"] * F.lit(1.0)
            s = s + F.when(c("q_domain").isNull(), 0.0).when(c("t_domain") == c("q_domain"), 3.5).when(c("t_domain").isNotNull(), -8.5).otherwise(0.0)
            bad = F.exists(x["negative"], lambda h: contains_word(x["title"], h))
            s = s + F.when(~bad, 0.0).when((n["t"] == 0) & (n["core"] == 0) & ~inside, -12.0).otherwise(-4.5)
            return F.round(s, 2)

        return T.let(F.struct(title_hits.alias("t"), desc_hits.alias("d"), core.alias("core"), in_tags.alias("tags")), total)

    known = (c("q_role") != "") & (c("t_role") != "")
    return F.when(known, T.let(_texts(description if description is not None else c("description"), cleaned), score)).otherwise(0.0)


def _head(n: int | None) -> Column:
    """The description, or its first ``n`` characters."""
    whole = F.coalesce(c("description"), F.lit(""))
    return whole if n is None else F.substring(whole, 1, n)


def fast_title_alignment(head: int | None = None) -> Column:
    """Cheap first ranking by token hits; the description counts as context, whole or its first ``head`` characters."""
    toks = lambda t: F.filter(F.split(T.clean_words(t), " "), lambda w: (w != "") & ~w.isin(*FAST_STOPWORDS))
    text = lambda arr: F.array_join(arr, " ")
    tags = F.array_join(F.coalesce(c("tags"), T.lit_array([])), " ")
    context = F.concat_ws(" ", c("title"), tags, _head(head))
    state = F.struct(toks(c("q_text")).alias("q"), toks(c("title")).alias("t"), toks(context).alias("x"))

    def score(s: Column) -> Column:
        q = F.array_distinct(s["q"])
        hits, seen = F.size(F.array_intersect(q, s["t"])), F.size(F.array_intersect(q, s["x"]))
        in_title, in_context = F.contains(text(s["t"]), text(s["q"])), F.contains(text(s["x"]), text(s["q"]))
        by_title = F.when(in_title, 12.0).when(hits == F.size(q), 9.0).otherwise(F.least(F.lit(7.0), hits * F.lit(3.0)))
        total = by_title + F.when(in_context & ~in_title, 2.5).otherwise(0.0) + F.least(F.lit(4.0), seen * F.lit(0.9))
        return F.when((F.size(s["q"]) == 0) | (F.size(s["t"]) == 0), 0.0).otherwise(F.round(total, 2))

    return T.let(state, score)


def role_fit(families: Sequence[str], adjacent: Sequence[str], token_context: bool = False, description: Column | None = None) -> Column:
    """Fit of a listing to the query's role; ``adjacent`` holds "role|role" pairs.

    Tokens count in the title's role only; ``token_context=True`` also counts them in
    description and tags.
    """
    raw = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), f"[^{T.LOWER}+ ]+", " ")
    tags = F.array_join(F.transform(F.coalesce(c("tags"), T.lit_array([])), F.lower), " ")
    desc = description if description is not None else c("description")
    state = F.struct(T.clean_words(c("q_text")).alias("query"), raw(c("title")).alias("title"), raw(desc).alias("desc"), tags.alias("tags"), F.split(c("t_role"), " ").alias("words"))

    def score(x: Column) -> Column:
        phrase = F.when(x["query"] == "", 0.0).when(F.contains(x["title"], x["query"]), 4.0).when(F.contains(x["desc"], x["query"]), 1.75).when(F.contains(x["tags"], x["query"]), 1.0).otherwise(0.0)
        named = c("q_role") != ""
        s = phrase + F.when(named & F.contains(c("t_role"), c("q_role")), 6.0).otherwise(0.0) + F.when(named & F.contains(x["desc"], c("q_role")), 3.0).otherwise(0.0)
        in_role = lambda t: F.array_contains(x["words"], t)
        s = s + _count(c("q_tokens"), in_role) * F.lit(2.0)
        if token_context:
            rest = F.filter(c("q_tokens"), lambda t: ~in_role(t))
            s = s + F.aggregate(rest, F.lit(0.0), lambda a, t: a + F.when(contains_word(x["desc"], t), 0.75).when(contains_word(x["tags"], t), 0.5).otherwise(0.0))
        hinted = F.exists(c("q_title_hints"), lambda h: F.contains(x["title"], h))
        s = s + F.when(hinted, 2.5).otherwise(0.0) + F.least(F.lit(3.0), F.size(F.array_intersect(F.transform(c("terms"), F.lower), c("q_market"))) * F.lit(0.75))
        bad = F.exists(c("q_negative"), lambda h: F.contains(x["title"], h))
        s = s * F.when(~bad, 1.0).when(hinted, 0.45).otherwise(0.12)
        s = s * F.when(F.coalesce(c("t_domain") != c("q_domain"), F.lit(False)), 0.18).otherwise(1.0)
        both = c("q_role").isin(*families) & c("t_role").isin(*families) & (c("q_role") != c("t_role"))
        near = F.concat_ws("|", c("q_role"), c("t_role")).isin(*(adjacent or ("",)))
        return F.round(s * F.when(~both, 1.0).when(near, 0.75).otherwise(0.4), 2)

    return T.let(state, score)


def term_overlap() -> Column:
    """1.5 per primary term and 1 per market term the listing asks for."""
    low = F.array_distinct(F.transform(c("terms"), F.lower))
    return T.let(low, lambda t: F.size(F.array_intersect(t, c("q_primary"))) * F.lit(1.5) + F.size(F.array_intersect(t, c("q_market"))))


def cleaned_texts(words: Column | None = None) -> dict[str, Column]:
    """Words of the description, and of title, description, tags and terms together: inputs of several scores, cleaned once.

    ``words`` is a column that holds the first of the two already.
    """
    words = T.clean_words(c("description")) if words is None else words
    tags, terms = (T.clean_words(F.array_join(F.coalesce(c(n), T.lit_array([])), " ")) for n in ("tags", "terms"))
    return {"desc_words": words, "all_words": T.join_clean(T.clean_words(c("t_text")), words, tags, terms)}


def title_overlaps(texts: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Counts of hints, family words, core words and specialty words found, and the precision of the title.

    ``texts`` are columns that hold :func:`cleaned_texts`.
    """
    texts = texts or cleaned_texts()
    hints = lambda t: _count(c("q_title_hints"), lambda h: T.contains_clean(t, T.clean_words(h)))
    title_overlap = T.let(T.clean_words(c("t_text")), hints)
    wanted = F.filter(F.split(c("q_role"), r"[^a-z0-9+]+"), lambda t: (F.length(t) > 2) & ~t.isin(*FAMILY_FILLERS))
    own = F.filter(F.split(c("t_text"), " "), lambda t: F.length(t) > 2)
    family_overlap = F.size(F.array_intersect(own, wanted))
    found = lambda hay, toks: T.let(hay, lambda h: _count(toks, lambda t: T.contains_clean(h, t)))
    core_title = found(T.clean_words(c("t_text")), c("q_tokens"))
    core_text = found(T.join_clean(T.clean_words(c("t_text")), texts["desc_words"]), c("q_tokens"))
    telling = F.filter(c("q_specialty"), lambda t: ~t.isin(*T.ROLE_STOPWORDS, *T.ROLE_GENERIC_TOKENS))
    special = found(texts["all_words"], telling)
    precise = lambda t, k, f: F.when(t >= 1, t * 2).when(k >= 2, k + f).when(f >= 2, f).otherwise(0)
    return {
        "title_overlap": title_overlap, "family_overlap": family_overlap, "core_title": core_title, "core_text": core_text, "specialty_overlap": special,
        "precision": T.let(F.struct(title_overlap.alias("t"), core_title.alias("k"), family_overlap.alias("f")), lambda x: precise(x["t"], x["k"], x["f"])),
    }


def unrequested_title_penalty() -> Column:
    """Points for leadership or architect titles the query does not ask for."""
    q, t = T.clean_label(c("q_text")), c("t_text")
    asked = F.arrays_overlap(F.split(q, " "), T.lit_array(LEADERSHIP))
    extra = lambda word: F.contains(t, F.lit(word)) & ~F.contains(q, F.lit(word))
    points = F.when(t.rlike(r"\b(manager|director|head|chief|vp|vice president)\b"), 2).otherwise(0) + extra("architect").cast("int") + extra("program manager").cast("int")
    return F.when((t == "") | asked, 0).otherwise(points)


def domain_match(title_overlap: Column, family_overlap: Column) -> Column:
    return F.when(c("q_domain").isNull(), 0).otherwise(
        F.when(c("t_domain") == c("q_domain"), 2).otherwise(0) + (title_overlap >= 1).cast("int") + (family_overlap >= 1).cast("int")
    )


# --- places ---------------------------------------------------------------------


def is_country_focused(requested: Column, hints: Sequence[str] = X.COUNTRY_HINTS) -> Column:
    return T.contains_any(T.clean_label(requested), hints)


def location_score(requested: Column, location: Column, remote: Column, country: str = X.COUNTRY, near: Sequence[str] = X.COUNTRY_HINTS,
                   region: Sequence[str] = X.REGION_HINTS, other: Sequence[str] = X.OTHER_REGION_HINTS, world: Sequence[str] = X.GLOBAL_HINTS) -> Column:
    """How well a listing's place meets the requested one, 0.52 to 1."""
    want, place, away = T.clean_label(requested), F.lower(F.trim(F.coalesce(location, F.lit("")))), F.coalesce(remote, F.lit(False))
    anywhere, blank = T.contains_any(place, world), place == ""
    focused = (
        F.when(T.contains_any(place, near), 1.0).when(T.contains_any(place, region), 0.88).when(away & blank, 0.84).when(anywhere, 0.82)
        .when(away & T.contains_any(place, other), 0.72).when(T.contains_any(place, other), 0.58).when(away, 0.66).otherwise(0.52)
    )
    return (
        F.when((want == "") | want.isin(*world), F.when(away | anywhere, 1.0).otherwise(0.82))
        .when(F.contains(place, want), 1.0).when(want == country, focused)
        .when(away & blank, 0.8).when(anywhere, 0.78).when(away, 0.68).otherwise(0.52)
    )


def location_tier(requested: Column, location: Column, remote: Column, country: str = X.COUNTRY, near: Sequence[str] = X.COUNTRY_HINTS,
                  region: Sequence[str] = X.REGION_HINTS, other: Sequence[str] = X.OTHER_REGION_HINTS, world: Sequence[str] = X.GLOBAL_HINTS) -> Column:
    """Named tier of the place; ``exact_country`` and ``near_region`` are the focused country and its region."""
    want, place, raw = T.clean_label(requested), T.clean_label(location), F.lower(F.trim(F.coalesce(location, F.lit(""))))
    away = F.coalesce(remote, F.lit(False)) | T.contains_any(place, world)
    focused = (
        F.when(T.contains_any(place, near), "exact_country").when(T.contains_any(place, region), "near_region").when(T.contains_any(place, world), "worldwide_remote")
        .when(away & (raw == ""), "remote_unspecified").when(away & T.contains_any(place, other), "remote_other_region").when(T.contains_any(place, other), "other_region")
        .when(away, "remote_other").when((raw == "") | (raw == "unknown"), "unknown").otherwise("other_location")
    )
    return (
        F.when((want == "") | want.isin(*world), F.when(away, "global_remote").otherwise("global_open"))
        .when((want == country) | is_country_focused(requested, near), focused)
        .when(F.contains(place, want), "exact").when(away, "remote_fallback").otherwise("other_location")
    )


def location_mismatch(requested: Column, tier: Column, near: Sequence[str] = X.COUNTRY_HINTS) -> Column:
    """A country-focused query rejects all but its country, its region and unknown places."""
    return is_country_focused(requested, near) & ~tier.isin("exact_country", "near_region", "unknown")


# --- listing and market quality ---------------------------------------------------


def listing_quality(n_words: Column, skill_count: Column, requirement: Column, title_overlap: Column, family_overlap: Column, domain_score: Column, low_signal: Column, weakeners: Column) -> Column:
    """Detail and relevance of a listing, 0 to 20."""
    s = F.lit(6.0) + F.when(n_words.between(90, 950), 4.0).when(n_words.between(45, 1200), 2.0).otherwise(0.0)
    s = s + F.when(skill_count >= 6, 4.0).when(skill_count >= 3, 2.0).otherwise(0.0) + F.when(requirement >= 36.0, 3.0).when(requirement >= 22.0, 1.5).otherwise(0.0)
    s = s + F.when(title_overlap >= 1, 2.0).otherwise(0.0) + F.when(family_overlap >= 1, 1.5).otherwise(0.0) + F.when(domain_score >= 2, 2.5).otherwise(0.0)
    s = s - F.when(low_signal, 4.0).otherwise(0.0) - F.when((title_overlap == 0) & (family_overlap == 0), F.least(F.lit(3.0), weakeners * F.lit(1.25))).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(s, F.lit(20.0))), 2)


def listing_text_signals(texts: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Inputs of :func:`listing_quality` read from the text (cleaned words, not mapped to a role)."""
    clean = (texts or cleaned_texts())["desc_words"]
    return {
        "n_words": F.size(F.filter(F.split(clean, " "), lambda w: w != "")), "low_signal": T.contains_any(clean, X.LOW_SIGNAL_HINTS),
        "weakeners": F.size(F.array_intersect(F.split(T.clean_words(c("title")), " "), T.lit_array(X.TITLE_WEAKENERS))),
    }


def market_quality(fit: Column, requirement: Column, skill_count: Column, hints: Column, primaries: Column, place: Column, quality: Column, source: Column) -> Column:
    base = fit * 10 + requirement + F.least(F.lit(10.0), skill_count * F.lit(1.5)) + hints * 8 + primaries * 12 + place * 18 + quality * F.lit(1.7)
    return F.round(base * trust(source, X.QUALITY_TRUST, X.QUALITY_TRUST_OTHER), 2)


def context_signals(texts: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Hits of title hints in the title, and of primary and market terms in the whole listing text."""
    whole = (texts or cleaned_texts())["all_words"]
    hits = lambda hay, items: T.let(hay, lambda h: _count(items, lambda n: T.contains_clean(h, T.clean_words(n))))
    return {"title_hint_hits": hits(T.clean_words(c("t_text")), c("q_title_hints")), "primary_hits": hits(whole, c("q_primary")), "market_hits": hits(whole, c("q_market"))}


def cache_bucket(cached_query: Column, query: Column, variations: Column, cached_role: Column, role: Column) -> Column:
    """exact, related, canonical or none: how a cached row's query relates to the asked one."""
    own, ask = T.clean_label(cached_query), T.clean_label(query)
    return F.when(own == "", "none").when(own == ask, "exact").when(F.array_contains(variations, own), "related").when(cached_role == role, "canonical").otherwise("none")


def match_strength(source: Column, confidence: Column, alignment: Column, fit: Column, overlap: Column) -> Column:
    base = F.when(confidence == "low", "Conservative fallback").when(confidence == "medium", "Guarded baseline").otherwise("Calibration baseline")
    live = F.when((alignment >= 24) | (fit >= 12), "Strong role match").when((alignment >= 12) | (fit >= 7) | (overlap >= 3), "Related role match").otherwise("Broad live match")
    return F.when(source == X.BASELINE_SOURCE, base).otherwise(live)


def match_reasons(alignment: Column, quality: Column, terms_by_demand: Column) -> Column:
    """Up to three reasons; ``terms_by_demand`` lists the listing's role terms, most demanded first."""
    named = F.when(alignment >= 24, "title matches the role").when(alignment >= 12, "title in the same family")
    signals = F.when(F.size(terms_by_demand) > 0, F.concat(F.lit("role terms: "), F.array_join(F.slice(terms_by_demand, 1, 3), ", ")))
    detail = F.when(quality >= 60, "detailed requirements")
    found = F.array_compact(F.array(named, signals, detail))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("kept after title, domain and term checks")))


def tag_overlap(query: Column, tags: Column) -> Column:
    """0.5 for each query token longer than two characters that occurs in the joined tags."""
    joined = F.lower(F.array_join(F.coalesce(tags, T.lit_array([])), " "))
    return T.let(joined, lambda j: _count(F.split(F.lower(query), T.SPACE + "+"), lambda t: (F.length(t) > 2) & F.contains(j, t)) * F.lit(0.5))


def candidates(listings: DataFrame, queries: DataFrame, titles: DataFrame, query_profiles: DataFrame, on: Sequence[str] = ("query_id",)) -> DataFrame:
    """Candidate rows: listings joined to their query and to the profiles of both labels.

    All joins are equi-joins; profiles are one row per distinct label.
    """
    expanded = F.when((F.col("expanded") != F.col("cleaned")) & (F.col("expanded") != ""), F.concat_ws(" ", "cleaned", "expanded")).otherwise(F.col("cleaned"))
    t = titles.select(F.col("label").alias("title"), F.col("role").alias("t_role"), F.col("role_domain").alias("t_domain"), expanded.alias("t_text"), F.col("heads").alias("t_heads"))
    q = query_profiles.select(
        F.col("label").alias("q_text"), F.col("role").alias("q_role"), F.col("role_domain").alias("q_domain"), F.col("tokens").alias("q_tokens"), F.col("specialty").alias("q_specialty"),
        F.col("title_hints").alias("q_title_hints"), F.col("negative_hints").alias("q_negative"), F.col("market_hints").alias("q_market"), F.col("primary_hints").alias("q_primary"),
        F.col("heads").alias("q_heads"),
    )
    return listings.join(queries, list(on)).join(t, ["title"]).join(q, ["q_text"])


def annotate(cand: DataFrame, families: Sequence[str], adjacent: Sequence[str], requested: str = "q_location", head: int | None = None) -> DataFrame:
    """All scores of a candidate row; for the role scores the description counts whole or its first ``head`` characters.

    Texts are cleaned in a projection of their own, once for all scores that search them; ``desc_words`` and ``all_words`` stay.
    """
    desc = _head(head)
    cand = cand.withColumn("desc_words", cleaned_texts()["desc_words"]).withColumn("all_words", cleaned_texts(c("desc_words"))["all_words"])
    texts = {n: c(n) for n in ("desc_words", "all_words")}
    low = F.array_distinct(F.transform(c("terms"), F.lower))
    tier = location_tier(c(requested), c("location"), c("remote"))
    first = cand.withColumns(
        {
            "title_alignment": title_alignment(desc, c("desc_words") if head is None else None), "role_fit": role_fit(families, adjacent, description=desc), "location_score": location_score(c(requested), c("location"), c("remote")),
            "location_tier": tier, **title_overlaps(texts), **listing_text_signals(texts), "skill_overlap": term_overlap(), "skill_count": F.size(low),
            "hint_overlap": F.size(F.array_intersect(low, c("q_market"))), "primary_overlap": F.size(F.array_intersect(low, c("q_primary"))),
        }
    )
    first = first.withColumn("domain_score", domain_match(c("title_overlap"), c("family_overlap")))
    second = first.withColumn(
        "listing_quality", listing_quality(c("n_words"), c("skill_count"), c("requirement_quality"), c("title_overlap"), c("family_overlap"), c("domain_score"), c("low_signal"), c("weakeners"))
    )
    return second.withColumn(
        "market_quality", market_quality(c("role_fit"), c("requirement_quality"), c("skill_count"), c("hint_overlap"), c("primary_overlap"), c("location_score"), c("listing_quality"), c("source"))
    )


def fast_profile(cand: DataFrame, title_terms: str = "title_terms", query_terms: str = "query_terms", max_terms: int = 10, head: int | None = None) -> DataFrame:
    """Cheap prior profile: baseline terms of the title, then of the query, with fixed weights."""
    key = lambda a: F.transform(a, lambda t: F.lower(F.trim(t)))
    both = F.array_distinct(F.filter(F.concat(key(F.slice(c(title_terms), 1, max_terms)), key(F.slice(c(query_terms), 1, max_terms))), lambda t: t != ""))
    marked = T.let(F.slice(both, 1, max_terms), lambda terms: F.transform(terms, lambda t: F.struct(t.alias("term"), F.when(F.array_contains(key(c(title_terms)), t), 0.46).otherwise(0.34).alias("weight"))))
    out = cand.withColumns({"prior": marked, "title_alignment": fast_title_alignment(head)})
    quality = F.when(F.size("prior") == 0, 6.0).when(c("title_alignment") > 0, 18.0).otherwise(10.0)
    return out.withColumns({"role_fit": F.round(F.greatest(F.lit(0.0), F.least(F.lit(14.0), c("title_alignment") / 2.8)), 2), "requirement_quality": quality})


def rank_per_source(annotated: DataFrame, k: int, tie: str) -> DataFrame:
    """Best ``k`` rows per query and source by alignment, fit, place and remote flag."""
    order = [F.desc("title_alignment"), F.desc("role_fit"), F.desc("location_score"), F.desc(F.coalesce(c("remote"), F.lit(False))), F.asc(tie)]
    return top_per_group(annotated, ["query_id", "source"], order, k, "rank")
