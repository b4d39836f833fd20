"""Requirement profiles of listings: phrases, weights, implied terms, profile, grounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators import terms as E
from docmarket.operators.ranking import top_per_group

# --- fixed values -------------------------------------------------------------
PROFILE_MIN, QUALITY_TERMS = 0.36, 6
REPEAT_BONUS, REPEAT_CAP = 0.06, 0.12
DAMPED = 0.34
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class RequirementLexicon:
    """Wording that marks requirement sentences; bounded lists."""

    required: Sequence[str] = X.REQUIRED_HINTS
    preferred: Sequence[str] = X.PREFERRED_HINTS
    duties: Sequence[str] = X.RESPONSIBILITY_HINTS
    low_signal: Sequence[str] = X.LOW_SIGNAL_HINTS
    heads: Sequence[str] = X.REQUIREMENT_HEADS
    soft: Sequence[str] = X.SOFT_TERMS
    noise: Sequence[str] = ()


def sentences(df: DataFrame, keys: Sequence, text: Column, lex: RequirementLexicon) -> DataFrame:
    """(keys, sent_no, sentence) without low-signal sentences."""
    split = F.filter(F.transform(F.split(T.normalize_ws(text), SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != "")
    out = T.explode_once(df, keys, split, "sentence", "sent_no")
    return out.filter(~T.contains_any(F.lower("sentence"), lex.low_signal))


def _marker(text: Column, lex: RequirementLexicon, required: float, preferred: float, duties: float, other: float) -> Column:
    return (
        F.when(T.contains_any(text, lex.required), required).when(T.contains_any(text, lex.preferred), preferred)
        .when(T.contains_any(text, lex.duties), duties).otherwise(other)
    )


def normalize_candidate(c: Column) -> Column:
    """A raw phrase without edge punctuation and lead words, lower case."""
    text = F.regexp_replace(F.lower(T.normalize_ws(c)), r"^[ ,;:.()\[\]{}]+|[ ,;:.()\[\]{}]+$", "")
    text = F.regexp_replace(text, X.LEADING_WORDS, "")
    return T.normalize_ws(F.regexp_replace(F.regexp_replace(text, r"^[^a-z0-9+#]+", ""), r"[^a-z0-9+#/& .-]+$", ""))


def candidate_phrases(listings: DataFrame, key: str, title: str, description: str, lex: RequirementLexicon) -> DataFrame:
    """(key, term, weight, snippet) of phrases in requirement sentences; terms are raw labels to canonicalise and check."""
    rows = sentences(listings, [key, F.lower(T.normalize_ws(F.col(title))).alias("low_title")], F.col(description), lex)
    low = F.lower("sentence")
    heads = F.filter(T.lit_array(lex.heads), lambda h: F.contains(low, h))
    after = F.transform(heads, lambda h: F.substring(F.col("sentence"), F.instr(low, h) + F.length(h), F.length("sentence")))
    colon = F.when(F.contains(F.col("sentence"), F.lit(":")), F.array(F.substring(F.col("sentence"), F.instr(F.col("sentence"), F.lit(":")) + 1, F.length("sentence")))).otherwise(T.lit_array([]))
    relevant = rows.filter(T.contains_any(low, lex.heads) | F.contains(low, F.lit(":")))
    segments = T.explode_once(relevant, [key, "low_title", "sentence"], F.concat(F.array("sentence"), after, colon), "segment")
    parts = T.explode_once(segments, [key, "low_title", "sentence", "segment"], F.array_distinct(F.transform(F.split("segment", X.PHRASE_SPLIT), normalize_candidate)), "term").filter("term <> ''")
    weight = F.lit(0.3) + F.when(T.contains_any(F.lower("sentence"), lex.required), 0.16).when(T.contains_any(F.lower("sentence"), lex.preferred), 0.08).otherwise(0.0)
    weight = F.least(F.lit(0.62), weight + F.when(F.contains(F.col("low_title"), F.col("term")), 0.08).otherwise(0.0))
    snippet = T.clip(F.when(F.contains(F.lower("segment"), F.col("term")), F.col("segment")).otherwise(F.col("sentence")), 200)
    return parts.select(key, "term", F.round(weight, 2).alias("weight"), snippet.alias("snippet")).distinct()


def valid_candidate(term: Column, known: Sequence[str], lex: RequirementLexicon, allowed: Sequence[str] = X.ALLOWED_SINGLETONS, components: Sequence[str] = X.ALLOWED_COMPONENTS) -> Column:
    """Could the phrase be a term: word lists, length, known parts, share of filler words."""
    is_known = term.isin(*known)

    def check(w: Column) -> Column:
        n = F.size(w)
        content = F.filter(w, lambda t: ~t.isin(*X.FILLER_TOKENS, "in"))
        part = lambda t: t.isin(*known) | t.isin(*allowed) | t.isin(*components)
        anchored = F.exists(content, lambda t: t.isin(*known) | t.isin(*X.ANCHOR_TOKENS))
        compound = is_known | (n < 2) | ((F.size(content) <= 3) & anchored & F.forall(content, part))
        blocked = F.exists(w, lambda t: t.isin(*X.BLOCKED_TOKENS)) | F.get(w, n - 1).isin(*X.GENERIC_ROLE_TERMS)
        single = (n == 1) & ~is_known & ~term.isin(*allowed)
        generic = F.exists(w, lambda t: t.isin(*X.GENERIC_SINGLETONS)) & ~is_known
        filler = F.size(F.filter(w, lambda t: t.isin(*X.FILLER_TOKENS))) / F.greatest(n, F.lit(1)) > 0.5
        return ~single & ~generic & ~blocked & (n <= 5) & compound & ~filler

    listed = term.isin(*lex.soft, *X.GENERIC_ROLE_TERMS, *lex.noise) | term.endswith(" level")
    opener = term.rlike("^(" + T.alternation(X.NON_TERM_OPENERS) + ")")
    plain = (F.length(term) >= 2) & term.rlike("[a-z]") & ~term.rlike(r"^\d+(?:\.\d+)?$")
    return plain & ~listed & ~opener & T.let(F.filter(F.split(term, " "), lambda t: t != ""), check)


def pattern_weights(hits: DataFrame, key: str, lex: RequirementLexicon) -> DataFrame:
    """(key, term, weight, n) from lexicon hits with their snippet and title; the best mention counts."""
    low, title = F.lower("snippet"), F.lower(T.normalize_ws(F.col("title")))
    verb = (F.col("term") == "excel") & low.rlike("you excel|excel in |must excel|will excel") & ~low.rlike("microsoft excel|advanced excel")
    kept = hits.filter(~F.col("term").isin(*(lex.soft or ("",))) & ~T.contains_any(low, lex.low_signal) & ~verb)
    weight = F.lit(0.36) + F.when(F.contains(title, F.col("term")), 0.18).otherwise(0.0) + _marker(low, lex, 0.34, 0.16, 0.08, 0.04)
    return kept.groupBy(key, "term").agg(F.round(F.max(weight), 2).alias("weight"), F.count(F.lit(1)).alias("n"))


def title_implied(listings: DataFrame, key: str, title: str, table: DataFrame) -> DataFrame:
    """(key, term, weight) from title phrases; ``table`` is (phrase, term, weight).

    The phrase is found by its word n-grams, so the table is an equi-join, not a scan per row;
    a phrase counts at word boundaries.
    """
    words = T.clean_words(F.col(title))
    keyed = table.withColumn("gram", T.clean_words(F.col("phrase"))).select("gram", "term", "weight")
    longest = keyed.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    grams = T.let(
        F.split(words, " "),
        lambda w: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))),
    )
    return T.explode_once(listings, [key], grams, "gram").join(keyed, ["gram"]).groupBy(key, "term").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def implied_terms(extracted: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, term, weight) implied by other extracted terms; ``table`` is (term, implied, weight)."""
    joined = extracted.select(key, "term").distinct().join(table, ["term"])
    return joined.groupBy(key, F.col("implied").alias("term")).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def proxy_terms(listings: DataFrame, key: str, title: str, text: str, patterns: Mapping[str, Sequence[str]], context: Mapping[str, Sequence[str]], lex: RequirementLexicon) -> DataFrame:
    """(key, term, weight) from phrases that stand for a term, with context words where the term asks for them."""
    low = F.lower("sentence")
    rows = sentences(listings, [key, F.lower(T.normalize_ws(F.col(title))).alias("low_title")], F.col(text), lex)
    found = []
    for term, regexes in patterns.items():
        words = list(context.get(term, ()))
        near = T.contains_any(low, words) if words else F.lit(True)
        hit = low.rlike("(?U)" + "|".join(f"(?:{r})" for r in regexes)) & (near | F.contains(low, F.col("low_title"))) & F.lit(term not in lex.soft)
        weight = F.lit(0.24) + F.when(F.contains(F.col("low_title"), F.lit(term)), 0.12).otherwise(0.0) + _marker(low, lex, 0.22, 0.12, 0.06, 0.0)
        weight = weight + (F.when(near, 0.08).otherwise(0.0) if words else F.lit(0.0))
        found.append(F.when(hit, F.struct(F.lit(term).alias("term"), weight.alias("weight"))))
    out = T.explode_once(rows, [key], F.array_compact(F.array(*found)), "x")
    return out.groupBy(key, F.col("x.term").alias("term")).agg(F.round(F.max("x.weight"), 2).alias("weight"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Specialism:
    """Title patterns with the terms they favour and the generic terms they damp."""

    patterns: Sequence[str]
    core: Sequence[str]
    generic: Sequence[str]


def requirement_profile(
    contributions: DataFrame, listings: DataFrame, key: str, title: str, specialisms: Sequence[Specialism] = (), scientific: Specialism | None = None
) -> DataFrame:
    """(key, term, weight, pos): terms of a listing by weight, at least 0.36.

    contributions: key, term, weight, n, extracted (a lexicon hit in the text). One
    aggregation over all modes; a term counts with its best weight plus a repeat bonus.
    """
    table = lambda items: F.array(*[F.struct(T.lit_array(s.patterns).alias("p"), T.lit_array(s.core).alias("core"), T.lit_array(s.generic).alias("generic")) for s in items])
    low = F.lower(T.normalize_ws(F.col(title)))
    none = T.lit_array([])

    def matched(items, field: str) -> Column:
        if not items:
            return none
        return T.let(low, lambda t: F.flatten(F.transform(F.filter(table(items), lambda s: F.exists(s["p"], lambda p: F.contains(t, p))), lambda s: s[field])))

    special, sci = list(specialisms), [scientific] if scientific else []
    marks = listings.select(
        key, low.alias("low_title"), matched(special, "core").alias("core"), matched(special, "generic").alias("generic"), matched(sci, "core").alias("s_core"), matched(sci, "generic").alias("s_generic")
    )
    agg = contributions.groupBy(key, "term").agg(F.max("weight").alias("base"), F.sum("n").alias("n"), F.max("extracted").alias("extracted"))
    c, one = F.col, F.lit(1.0)
    rows = agg.join(marks, [key])
    w = F.least(one, c("base") + F.least(F.lit(REPEAT_CAP), (c("n") - 1) * F.lit(REPEAT_BONUS)))
    w = F.when(F.array_contains("s_core", c("term")), F.least(one, w + 0.05)).otherwise(w)
    w = F.when(F.array_contains("s_generic", c("term")) & (c("n") < 2) & ~c("extracted"), F.least(w, F.lit(DAMPED))).otherwise(w)
    w = F.when(F.array_contains("core", c("term")), F.least(one, w + 0.06)).otherwise(w)
    w = F.when(F.array_contains("generic", c("term")) & (c("n") < 3) & ~F.contains(c("low_title"), c("term")), F.least(w, F.lit(DAMPED))).otherwise(w)
    return rows.select(key, "term", F.round(w, 2).alias("weight")).filter(c("weight") >= PROFILE_MIN)


def assemble_profile(profile: DataFrame, key: str, evidence: DataFrame | None = None) -> DataFrame:
    """One row per listing: ordered terms, weights map, quality, up to two evidence snippets per term.

    A listing has at most as many terms as the lexicon, so its arrays are bounded.
    """
    item = F.struct((-F.col("weight")).alias("w"), "term")
    out = profile.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    top = F.slice("items", 1, QUALITY_TERMS)
    out = out.select(
        key, F.transform("items", lambda x: x["term"]).alias("terms"), F.map_from_entries(F.transform("items", lambda x: F.struct(x["term"], -x["w"]))).alias("weights"),
        # Weights have two decimals; hundredths are summed as whole numbers, so no order of the sum can turn a half.
        F.round(F.aggregate(top, F.lit(0).cast("bigint"), lambda a, x: a + F.round(-x["w"] * 100).cast("bigint")) / F.size(top), 1).alias("quality"),
    )
    if evidence is None:
        return out
    shown = top_per_group(evidence.join(profile.select(key, "term"), [key, "term"], "left_semi"), [key, "term"], [F.asc("snippet")], 2)
    snippets = shown.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "snippet"))).alias("evidence"))
    return out.join(snippets, [key], "left")


def ground_terms(candidates: DataFrame, weights: DataFrame, keep: DataFrame, add: DataFrame, evidence: DataFrame, baseline: DataFrame, key: str = "listing_id", query: str = "query_id") -> DataFrame:
    """(key, term, weight) after an external keep/add list, which is an input table.

    candidates: query, key, term; weights: key, term, weight; keep and add: query, term;
    evidence: key, term (added terms found in the listing's text); baseline: key (modelled listings).
    A query whose keep list names none of its terms keeps all. Added terms need evidence in the text.
    """
    named = keep.join(candidates.select(query, "term").distinct(), [query, "term"], "left_semi")
    guided = named.select(query).distinct()
    kept = candidates.join(named, [query, "term"], "left_semi").unionByName(candidates.join(guided, [query], "left_anti"))
    listed = candidates.select(query, key).distinct()
    added = listed.join(add, [query]).join(evidence.select(key, "term").distinct(), [key, "term"], "left_semi")
    both = kept.select(key, "term").union(added.select(key, "term")).distinct()
    modelled = baseline.select(key).distinct().withColumn("__base", F.lit(True))
    out = both.join(weights, [key, "term"], "left").join(modelled, [key], "left")
    return out.select(key, "term", F.coalesce("weight", F.when(F.col("__base"), 0.70).otherwise(0.82)).alias("weight"))


def title_fallback_profile(listings: DataFrame, profile: DataFrame, models: DataFrame, key: str, title: str, n: int = 5, weight: float = 0.36, quality: float = 36.0) -> DataFrame:
    """Listings without extracted terms but with a recognised title: its first baseline terms.

    models: label, recognised, baseline_terms (one row per distinct title).
    """
    bare = listings.join(profile.select(key).distinct(), [key], "left_anti")
    known = models.filter("recognised").select(F.col("label").alias(title), F.slice("baseline_terms", 1, n).alias("terms"))
    out = T.explode_once(bare.join(known, [title]), [key], F.col("terms"), "term", "pos")
    return out.select(key, "term", F.lit(weight).alias("weight"), (F.col("pos") + 1).alias("pos"), F.lit(quality).alias("quality"), F.lit("title-variant-inferred").alias("mode"))
