"""Requirement profiles kept by content: texts that are known and current are not parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.operators.ranking import first_per_key
from docmarket.session import cut_lineage
from docmarket.sources.listings import PROFILE_VERSION, needs_profile_refresh

# --- fixed values: the extras that belong to a profile ---
PROFILE_EXTRAS = ("skills", "skill_weights", "skill_evidence", "skill_extraction_mode", "requirement_quality", "normalization_version")
# ---------------------------------------------------------
PARTS = ("terms", "weights", "evidence", "quality", "mode", "version")


def content_hash(title: Column, description: Column, tags: Column) -> Column:
    """Hash of what a profile is made of."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.to_json(F.struct(text(title).alias("t"), text(description).alias("d"), F.coalesce(tags, F.array().cast("array<string>")).alias("g"))), 256)


def stale_texts(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(content_hash, title, description, tags) of listings without a current profile: one row a text, however many copies.

    listings: source, title, description, tags. Baseline listings keep the profile they came with.
    """
    own = first_per_key(profiles, ["content_hash"], [F.desc_nulls_last("version")])
    current = own.filter(~needs_profile_refresh(F.col("version"), F.col("terms"), F.col("weights"), F.col("evidence"), F.col("mode"), F.lit("feed")))
    texts = listings.filter(F.coalesce(F.col("source") != "role-baseline", F.lit(True))).select(content_hash(F.col("title"), F.col("description"), F.col("tags")).alias("content_hash"), "title", "description", "tags")
    # The hash stands for the text: copies are dropped on it alone, after those that are current.
    return texts.join(current.select("content_hash"), ["content_hash"], "left_anti").dropDuplicates(["content_hash"])


def refresh_profiles(listings: DataFrame, profiles: DataFrame, build: Callable[[DataFrame], DataFrame], version: int = PROFILE_VERSION, mode: str = "weighted-pattern") -> DataFrame:
    """The profile table with current profiles of all listings' texts; those of texts no listing has any more stay.

    profiles: content_hash, terms, weights, evidence, quality, mode, version. ``build`` gets the stale texts alone and
    returns content_hash, terms, weights, evidence, quality; a text for which it finds nothing gets empty parts, and is
    tried again at the next refresh, as its parts are missing.
    """
    # Kept, as the builder and two joins read it: the texts are hashed once. That adds about the size of the stale texts to the shared folder.
    stale = cut_lineage(stale_texts(listings, profiles))
    made = stale.select("content_hash").join(build(stale), ["content_hash"], "left")
    kinds = {c: profiles.schema[c].dataType for c in PARTS}
    empty = {"terms": F.array(), "weights": F.create_map(), "evidence": F.array(), "quality": F.lit(0.0)}
    fresh = made.select("content_hash", *[F.coalesce(F.col(c).cast(kinds[c]), x.cast(kinds[c])).alias(c) for c, x in empty.items()], F.lit(mode).cast(kinds["mode"]).alias("mode"), F.lit(version).cast(kinds["version"]).alias("version"))
    kept = first_per_key(profiles, ["content_hash"], [F.desc_nulls_last("version")]).join(stale.select("content_hash"), ["content_hash"], "left_anti")
    return kept.select("content_hash", *PARTS).unionByName(fresh)


def with_profiles(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listings with their text's profile in place of the one they had; all extras that are no part of a profile stay.

    listings: source, title, description, tags, extras (map). Baseline listings are left as they are.
    """
    own = profiles.select("content_hash", F.struct(*PARTS).alias("__new"))
    keyed = listings.withColumn("content_hash", content_hash(F.col("title"), F.col("description"), F.col("tags")))
    joined = keyed.join(own, ["content_hash"], "left")
    changed = F.col("__new").isNotNull() & F.coalesce(F.col("source") != "role-baseline", F.lit(True))
    had = F.col("profile") if "profile" in listings.columns else F.lit(None)
    rest = F.map_filter("extras", lambda k, v: ~k.isin(*PROFILE_EXTRAS))
    return joined.withColumns({"profile": F.when(changed, F.col("__new")).otherwise(had), "extras": F.when(changed, rest).otherwise(F.col("extras"))}).drop("__new")


def lexicon_builder(lexicon: DataFrame, rules, specialisms=(), scientific=None) -> Callable[[DataFrame], DataFrame]:
    """Builder of profiles from lexicon terms in title and description: snippets, weights by their wording, two snippets as evidence."""
    from docmarket.operators import requirements as Q, terms as E

    def build(texts: DataFrame) -> DataFrame:
        body = texts.select("content_hash", "title", F.concat_ws("\n", "title", "description", F.array_join("tags", " ")).alias("body"))
        shown = cut_lineage(E.term_snippets(body, ["content_hash", "title"], "body", lexicon))  # for the weights and for the evidence
        weights = Q.pattern_weights(shown, "content_hash", rules).withColumn("extracted", F.lit(True))
        profile = Q.requirement_profile(weights, texts, "content_hash", "title", specialisms, scientific)
        return Q.assemble_profile(profile, "content_hash", shown.select("content_hash", "term", "snippet"))

    return build
