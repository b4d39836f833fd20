"""Duplicate handling, merging of ranked lists, cached fall-back, overlap join, run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.functions.text import explode_once, ROLE_GENERIC_TOKENS, ROLE_STOPWORDS, URL, clean_label, clean_words, lit_array, normalize_ws, token_set
from docmarket.operators.ranking import first_per_key, top_per_group, with_group_size, with_previous


def dedupe_key(source: Column, external_id: Column, url: Column, role: Column, company: Column) -> Column:
    """source::id, else source::url, else source::role::company."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    src = F.lower(F.trim(F.coalesce(source, F.lit("unknown"))))
    return (
        F.when(low(external_id) != "", F.concat_ws("::", src, low(external_id)))
        .when(low(url) != "", F.concat_ws("::", src, low(url)))
        .otherwise(F.concat_ws("::", src, role, normalize_ws(F.lower(company))))
    )


def dedupe_listings(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """First arrival per key."""
    return first_per_key(df, [key], [F.asc(arrival)])


def near_signature(company: Column, title: Column, description: Column) -> Column:
    """company::title::first ten telling description words (labels cleaned, not mapped to roles)."""
    label = lambda c: F.coalesce(F.nullif(clean_label(c), F.lit("")), F.lit("unknown"))
    skip = lit_array(ROLE_STOPWORDS + ROLE_GENERIC_TOKENS)
    tokens = F.filter(F.split(clean_words(description), " "), lambda t: (F.length(t) > 3) & ~F.array_contains(skip, t))
    return F.concat_ws("::", label(company), label(title), F.array_join(F.slice(tokens, 1, 10), " "))


def near_duplicates(df: DataFrame, signature: str, arrival: str, exempt: Column) -> DataFrame:
    """First arrival per signature; exempt rows always stay and shadow nobody."""
    flagged = df.withColumn("__exempt", F.coalesce(exempt, F.lit(False)))
    once = first_per_key(flagged.filter(~F.col("__exempt")), [signature], [F.asc(arrival)])
    return once.unionByName(flagged.filter("__exempt")).drop("__exempt")


def listing_signature(source: Column, company: Column, title: Column, description: Column, n_words: int = 36) -> Column:
    """source|company|title|head of the description, spelling-insensitive."""
    low = lambda c: normalize_ws(F.lower(c))
    # The first words are cut out by pattern, so the rest of the text is not split into an array.
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), URL, ""), "[^a-z0-9]+", " ")
    head = F.trim(F.regexp_extract(plain, r"^ ?((?:\S+ ){0,%d}\S*)" % (n_words - 1), 1))
    return F.concat_ws("|", F.coalesce(source, F.lit("unknown")), low(company), low(title), head)


def with_dup_divisor(df: DataFrame, signature: str, name: str = "dup_divisor") -> DataFrame:
    """Size of the group of copies a listing belongs to."""
    return with_group_size(df, [signature], name)


def merge_ranked(primary: DataFrame, extra: DataFrame, limit: int) -> DataFrame:
    """Primary rows first, then extra; a row is kept if no kept row has its key or its signature.

    Columns: query_id, rank, key, signature. Lists may be of any length; the scan sees only the
    first rows of each, without a change of the result. The scan is exact: a dropped row does not block later ones.
    """
    rows = primary.withColumn("origin", F.lit(0)).unionByName(extra.withColumn("origin", F.lit(1)))
    # Exact copies of a (key, signature) can never be kept after the first.
    rows = first_per_key(rows, ["query_id", "key", "signature"], [F.asc("origin"), F.asc("rank")])
    order = [F.asc("origin"), F.asc("rank"), F.asc("key"), F.asc("signature")]
    # A row is dropped for a kept row of its key or signature. If ``limit`` earlier rows of its key, all with
    # other signatures, were dropped too, as many rows are kept already; the same holds for its signature.
    rows = top_per_group(rows, ["query_id", "key"], order, limit)
    rows = top_per_group(rows, ["query_id", "signature"], order, limit)
    # A kept row then drops less than 2 * limit others, so after this many rows the list is full.
    rows = top_per_group(rows, ["query_id"], order, 2 * limit * limit)
    item = F.struct("origin", "rank", "key", "signature")
    per_query = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.slice(F.col("items"), 1, 0)

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["key"] == x["key"]) | (y["signature"] == x["signature"]))
        return F.when((F.size(kept) >= limit) | clash, kept).otherwise(F.concat(kept, F.array(x)))

    merged = per_query.select("query_id", F.posexplode(F.aggregate("items", empty, step)).alias("pos", "x"))
    return merged.select("query_id", (F.col("pos") + 1).alias("position"), "x.origin", "x.rank", "x.key", "x.signature")


def blend_with_cache(live: DataFrame, cached: DataFrame, floors: DataFrame, select) -> DataFrame:
    """Top up thin queries from the cache.

    ``floors`` has (query_id, floor). A query under its floor is re-selected from
    live and cached rows (live first, deduplicated on ``key``) by ``select(df)``; the result
    replaces the live rows only if it has more of them.
    """
    counts = live.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_live"))
    thin = floors.join(counts, ["query_id"], "left").filter(F.coalesce("n_live", F.lit(0)) < F.col("floor"))
    thin = thin.select("query_id", F.coalesce("n_live", F.lit(0)).alias("n_live"))
    both = live.withColumn("origin", F.lit(0)).unionByName(cached.withColumn("origin", F.lit(1)))
    pool = first_per_key(both.join(thin, ["query_id"], "left_semi"), ["query_id", "key"], [F.asc("origin"), F.asc("rank")])
    chosen = select(pool)
    grown = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(thin, ["query_id"]).filter("n > n_live").select("query_id")
    kept = live.withColumn("origin", F.lit(0)).join(grown, ["query_id"], "left_anti")
    return kept.unionByName(chosen.join(grown, ["query_id"], "left_semi"))


CACHE_BUCKETS = ("exact", "related", "canonical")


def cache_fallback(cached: DataFrame, safe: Column) -> DataFrame:
    """Rows of the first non-empty bucket per query; the last bucket only counts safe rows."""
    order = F.array_position(lit_array(CACHE_BUCKETS), F.col("cache_bucket")).cast("int")
    usable = cached.withColumn("bucket_rank", order).filter((F.col("bucket_rank") > 0) & ((F.col("cache_bucket") != "canonical") | safe))
    best = usable.groupBy("query_id").agg(F.min("bucket_rank").alias("bucket_rank"))
    return usable.join(best, ["query_id", "bucket_rank"], "left_semi")


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, min_share: float, k: int, agree: int = 3) -> DataFrame:
    """For each left text the ``k`` right texts with the largest shared-token share, share >= ``min_share``.

    share = shared tokens / right tokens. A pair that reaches ``min_share`` shares at least
    ``a = ceil(min_share * n)`` of the right text's n tokens, so of its rarest ``n - a + e`` it must share e.
    Only those are joined on, e being ``agree`` or a if that is less: exact, and frequent tokens never bring all
    pairs together. Pairs are counted by their shared prefix tokens, and only those with e of them,
    whose left text has a tokens at all, fetch both token arrays.
    """
    lt = left.select(left_id, token_set(F.col(text)).alias("l_tokens"))
    rt = right.select(right_id, token_set(F.col(text)).alias("r_tokens")).filter(F.size("r_tokens") > 0)
    r_tok = explode_once(rt, [right_id, F.size("r_tokens").alias("n")], F.col("r_tokens"), "token")
    seen = explode_once(lt, [], F.col("l_tokens"), "token").join(r_tok.select("token").distinct(), ["token"], "left_semi")
    freq = seen.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    # Tokens no left text has cannot start a pair; they are the rarest of all and come first.
    ranked = r_tok.join(freq, ["token"], "left").groupBy(right_id).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token"))).alias("ordered")
    )
    least = F.greatest(F.ceil(F.col("n") * F.lit(min_share) - F.lit(1e-9)).cast("int"), F.lit(1))
    ranked = ranked.withColumn("__a", least).withColumn("__e", F.least("__a", F.lit(agree)))
    prefix = F.slice("ordered", F.lit(1), F.col("n") - F.col("__a") + F.col("__e"))
    rare = ranked.select(right_id, "__a", "__e", F.explode(prefix).alias("t")).filter("t.freq > 0").select(right_id, "__a", "__e", F.col("t.token").alias("token"))
    pairs = explode_once(lt, [left_id, F.size("l_tokens").alias("__m")], F.col("l_tokens"), "token").join(rare, ["token"]).filter("__m >= __a")
    pairs = pairs.groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("__c"), F.first("__e").alias("__e")).filter("__c >= __e").select(left_id, right_id)
    scored = pairs.join(lt, [left_id]).join(rt, [right_id]).select(
        left_id, right_id, F.size(F.array_intersect("l_tokens", "r_tokens")).alias("shared"), F.size("r_tokens").alias("n_right")
    )
    scored = scored.withColumn("share", F.col("shared") / F.col("n_right")).filter(F.col("share") >= F.lit(min_share) - F.lit(1e-9))
    return top_per_group(scored, [left_id], [F.desc("share"), F.asc(right_id)], k, "rank")


COMPONENTS = ("skill_match", "semantic_match", "experience_match", "market_demand", "resume_quality", "ats_compliance")


def compare_runs(runs: DataFrame, components: Sequence[str] = COMPONENTS, bucket: str = "month") -> DataFrame:
    """Each run against the newest older-or-equal run of the same user and role, else the newest other.

    Runs at the same instant count as older-or-equal to each other.
    """
    payload = ["run_id", "overall_score", *components]
    keyed = runs.withColumn("__role", F.lower(normalize_ws(F.col("role_query"))))
    seen = with_previous(keyed, ["user_id", "__role"], "created_at", "run_id", payload, F.date_trunc(bucket, F.col("created_at")))
    # Last run of the same instant; a run that is not that one compares with it.
    same = keyed.groupBy("user_id", "__role", "created_at").agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*payload), F.col("run_id")).alias("__twin")
    ).filter("__n > 1").drop("__n")
    seen = seen.join(same, ["user_id", "__role", "created_at"], "left")
    other = F.when(F.col("newest.run_id") != F.col("run_id"), F.col("newest"))
    twin = F.when(F.col("__twin.run_id") != F.col("run_id"), F.col("__twin"))
    seen = seen.withColumn("base", F.coalesce(twin, F.col("previous"), other))
    delta = lambda c: F.round(F.col(c) - F.coalesce(F.col(f"base.{c}"), F.lit(0.0)), 2)
    score_delta = delta("overall_score")
    word = F.when(score_delta > 0, "increased").when(score_delta < 0, "decreased").otherwise("stayed the same")
    return seen.select(
        "run_id", "user_id", F.col("base.run_id").alias("previous_run_id"), score_delta.alias("score_delta"),
        *[delta(c).alias(f"{c}_delta") for c in components],
        F.when(F.col("base").isNull(), F.lit("baseline")).otherwise(word).alias("direction"),
    )


def run_history(runs: DataFrame, per_user: int | None = None) -> DataFrame:
    """Runs by user, newest first; the position is added when only the newest few are asked for."""
    if per_user is None:
        return runs.orderBy("user_id", F.desc("created_at"), F.asc("run_id"))
    return top_per_group(runs, ["user_id"], [F.desc("created_at"), F.asc("run_id")], per_user, "position")
