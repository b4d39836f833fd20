"""Ranking and selection of listings per query under diversity caps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.operators.ranking import ROWS_PER_RANGE, first_per_key, rank_rows, top_per_group

# --- fixed values -------------------------------------------------------------
RANK_KEYS = (
    "alignment", "focused_location", "title_alignment", "precision", "-penalty", "domain_score", "location_score", "title_overlap", "core_title",
    "skill_overlap", "role_fit", "market_quality",
)
BASE_CAPS = {"remoteok": 2, "arbeitnow": 1, "greenhouse": 5, "lever": 5, "remotive": 4, "jobicy": 4, "themuse": 4, "jooble": 4, "adzuna": 4}
OTHER_CAP, SELECTION_MAX = 3, 15
# ------------------------------------------------------------------------------


def rank_order(tie: str, keys: Sequence[str] = RANK_KEYS) -> list[Column]:
    """The order of candidates: twelve keys, descending unless named with a minus; a last key makes ties stable."""
    return [*(F.asc(key[1:]) if key.startswith("-") else F.desc(key) for key in keys), F.asc(tie)]


def rank_candidates(cand: DataFrame, tie: str, k: int | None = None, keys: Sequence[str] = RANK_KEYS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """All rows of a query with their rank, a hot query in ranges of its order; with ``k`` its best ``k`` rows, cut before the shuffle."""
    if k is None:
        return rank_rows(cand, ["query_id"], [*((key.removeprefix("-"), not key.startswith("-")) for key in keys), (tie, False)], "rank", rows_per_range)
    return top_per_group(cand, ["query_id"], rank_order(tie, keys), k, "rank")


def source_cap(source: Column, target: Column, sources: Column, limit: Column) -> Column:
    """Most rows of one source: a base by source class, more when few sources are active."""
    base = F.coalesce(F.try_element_at(T.lit_map(BASE_CAPS), F.lower(source)), F.lit(OTHER_CAP))
    even = F.ceil(target / F.greatest(sources, F.lit(1))).cast("int") + 1
    return F.greatest(base, F.least(limit, even))


def cap_per_company(cand: DataFrame, cap: int, limit: int, order: Sequence[Column]) -> DataFrame:
    """At most ``cap`` rows per query and company, then the first ``limit``, both in ``order``."""
    return top_per_group(top_per_group(cand, ["query_id", "company"], order, cap), ["query_id"], order, limit, "position")


@dataclass(frozen=True)
class Wave:
    """One pass over the ranked rows: which rows, how many per company, and until which count it starts."""

    flag: str
    company_cap: int
    until: str = "live_target"  # query column: the wave starts only below this count
    ignore_source_cap: bool = False


WAVES = (
    Wave("is_strong", 2), Wave("is_secondary", 3), Wave("is_family", 4), Wave("is_recovery", 5, ignore_source_cap=True), Wave("is_related", 4),
    Wave("is_last_resort", 5, until="display_floor"),
)


def select_diverse(ranked: DataFrame, queries: DataFrame, waves: Sequence[Wave] = WAVES, limit: int = SELECTION_MAX, max_title_cap: int = 4) -> DataFrame:
    """Greedy selection in waves, exact, with caps on company, company+title, signature and source.

    ranked:  query_id, rank, key, source, company, title_key, signature, source_cap, title_cap_low,
             title_cap (used below / from the display floor), similar_ok_low, similar_ok, and one flag per wave
    queries: query_id, live_target, display_floor

    The scan is sequential per query, so its input is cut first, without changing the
    result: rows that agree in company, title, signature, source and caps are accepted or
    refused alike within a wave, and at most ``max_title_cap`` of them are ever taken, so
    twice that many per wave suffice. A company is full after its cap and at most ``limit``
    signatures, titles and companies can block, which bounds the rows needed per company and per
    source in the same way. What is left per query is a bounded array.
    """
    same = ["company", "title_key", "signature", "source", "source_cap", "title_cap_low", "title_cap", "similar_ok_low", "similar_ok"]
    per_same = 2 * max_title_cap
    per_company = (limit + max(w.company_cap for w in waves)) * (limit + max_title_cap) * per_same
    per_source = 2 * limit * per_company
    flags = F.array(*[F.when(F.col(w.flag), F.lit(i)) for i, w in enumerate(waves)])
    events = T.explode_once(ranked, ["query_id", "rank", "key", *same], F.array_compact(flags), "wave")
    order = [F.asc("rank")]
    events = top_per_group(events, ["query_id", "wave", *same], order, per_same)
    events = top_per_group(events, ["query_id", "wave", "company", "source"], order, per_company)
    events = top_per_group(events, ["query_id", "wave", "source"], order, per_source)
    item = F.struct("wave", "rank", "key", *same)
    per_query = events.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items")).join(queries, ["query_id"])
    none = F.transform(F.slice("items", 1, 0), lambda x: x)
    # Per wave: company cap, the count below which it starts, and whether the source cap is ignored.
    rules = F.array(*[F.struct(F.lit(w.company_cap).alias("cap"), F.col(w.until).cast("int").alias("until"), F.lit(w.ignore_source_cap).alias("free")) for w in waves])
    start = F.struct(none.alias("kept"), F.lit(-1).alias("wave"), F.lit(False).alias("open"))

    def step(state: Column, x: Column) -> Column:
        kept, n = state["kept"], F.size(state["kept"])
        fresh = x["wave"] != state["wave"]
        is_open = F.when(fresh, n < F.get(rules, x["wave"])["until"]).otherwise(state["open"])
        rule, low = F.get(rules, x["wave"]), n < F.col("display_floor")
        count = lambda test: F.size(F.filter(kept, test))
        title_cap = F.when(low, x["title_cap_low"]).otherwise(x["title_cap"])
        similar = F.when(low, x["similar_ok_low"]).otherwise(x["similar_ok"] & (n < F.col("live_target")))
        ok = (
            is_open & (n < limit) & ~F.exists(kept, lambda y: y["key"] == x["key"]) & (count(lambda y: y["company"] == x["company"]) < rule["cap"])
            & (count(lambda y: (y["company"] == x["company"]) & (y["title_key"] == x["title_key"])) < title_cap)
            & (similar | ~F.exists(kept, lambda y: y["signature"] == x["signature"]))
            & (rule["free"] | low | (count(lambda y: y["source"] == x["source"]) < x["source_cap"]))
        )
        return F.struct(F.when(ok, F.concat(kept, F.array(x))).otherwise(kept).alias("kept"), x["wave"].alias("wave"), is_open.alias("open"))

    chosen = per_query.select("query_id", F.aggregate("items", start, step, lambda s: s["kept"]).alias("kept"))
    out = T.explode_once(chosen, ["query_id"], F.col("kept"), "x", "pos")
    return out.select("query_id", (F.col("pos") + 1).alias("position"), "x.wave", "x.rank", "x.key", "x.source", "x.company")


def fill_to_floor(selected: DataFrame, safe: DataFrame, floors: DataFrame, tie: str) -> DataFrame:
    """Append safe rows to queries under their floor, if the query has enough safe rows.

    selected and safe: query_id, key; floors: query_id, floor.
    """
    size = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    short = floors.join(size(selected, "n"), ["query_id"], "left").join(size(safe, "n_safe"), ["query_id"], "left").fillna(0, ["n", "n_safe"])
    short = short.filter((F.col("n") < F.col("floor")) & (F.col("n_safe") >= F.col("floor"))).select("query_id", (F.col("floor") - F.col("n")).alias("missing"))
    spare = first_per_key(safe.join(short, ["query_id"]), ["query_id", "key"], [F.asc(tie)]).join(selected.select("query_id", "key"), ["query_id", "key"], "left_anti")
    added = spare.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc(tie)))).filter(F.col("__n") <= F.col("missing"))
    return selected.select("query_id", "key", F.lit(False).alias("filled")).unionByName(added.select("query_id", "key", F.lit(True).alias("filled")))


def top_matches_reserved(scored: DataFrame, tie: str, limit: int = 20) -> DataFrame:
    """Live rows by relevance, at most ``limit``; a blended sample gives its last place to the best baseline row."""
    live = F.col("source") != X.BASELINE_SOURCE
    order = [F.desc(live), F.desc("relevance"), F.asc(tie)]
    top = top_per_group(scored, ["query_id"], order, limit, "position")
    mix = scored.groupBy("query_id").agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_base"))
    # Only a query with `limit` or more live rows has no baseline row on the list yet.
    full = mix.filter((F.col("n_live") >= limit) & (F.col("n_base") > 0)).select("query_id")
    best = top_per_group(scored.filter(~live).join(full, ["query_id"], "left_semi"), ["query_id"], [F.desc("relevance"), F.asc(tie)], 1).withColumn("position", F.lit(limit))
    kept = top.join(full.withColumn("__full", F.lit(True)), ["query_id"], "left").filter(F.col("__full").isNull() | (F.col("position") < limit)).drop("__full")
    return kept.unionByName(best)


def best_stage(stages: DataFrame) -> DataFrame:
    """Strongest stage per query: most rows, then most sources, then the highest summed signal; the earliest on ties.

    stages: query_id, stage, stage_no, source, signal (one row per selected listing).
    """
    per = stages.groupBy("query_id", "stage", "stage_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("signal"), 4).alias("signal"))
    wide = stages.select("query_id", "stage", "source").distinct().groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n_sources"))
    joined = per.join(wide, ["query_id", "stage"])
    best = joined.groupBy("query_id").agg(F.max_by(F.struct("stage", "n", "n_sources", "signal"), F.struct("n", "n_sources", "signal", -F.col("stage_no"))).alias("b"))
    return best.select("query_id", "b.*")


def weakest_components(runs: DataFrame, key: str, components: Sequence[str], k: int) -> DataFrame:
    """The ``k`` lowest of the component scores of a run; found inside the row."""
    items = F.array(*[F.struct(F.col(n).alias("score"), F.lit(i).alias("no"), F.lit(n).alias("component")) for i, n in enumerate(components)])
    out = T.explode_once(runs, [key], F.slice(F.array_sort(items), 1, k), "x", "pos")
    return out.select(key, (F.col("pos") + 1).alias("position"), "x.component", "x.score")


def nearest_location_pool(cand: DataFrame, tier: Column) -> DataFrame:
    """Rows of the nearest tier a query has (1 exact, 2 region, 3 any)."""
    tiered = cand.withColumn("__tier", tier)
    best = tiered.groupBy("query_id").agg(F.min("__tier").alias("__tier"))
    # Without an exact or regional row all rows stay, so "any" is one tier.
    return tiered.join(best, ["query_id", "__tier"], "left_semi").drop("__tier")


def cap_per_group(cand: DataFrame, group: str, cap: int, n: int, order: Sequence[Column]) -> DataFrame:
    """At most ``cap`` rows per query and group, then the best ``n``; rows without a group are left out."""
    capped = top_per_group(cand.filter(F.coalesce(group, F.lit("")) != ""), ["query_id", group], order, cap)
    return top_per_group(capped, ["query_id"], order, n, "position")
