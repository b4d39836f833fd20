"""The listing table: look-ups, upsert, expiry, deletion, report sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.operators.ranking import first_per_key, top_per_group

# --- fixed values -------------------------------------------------------------
TTL_MINUTES = 360
CANDIDATE_LIMIT = 140
PROFILE_VERSION = 6
CURRENT_MODES = ("weighted-pattern", "hybrid")
# ------------------------------------------------------------------------------


def is_live(now: Column, until: str = "cached_until") -> Column:
    """Not expired: no end set, or an end after ``now``."""
    return F.col(until).isNull() | (F.col(until) > now)


def _newest(live: DataFrame, queries: DataFrame, on: Sequence[str], tie: str) -> DataFrame:
    # The order does not depend on the query: groups are cut to the largest limit any query
    # asks for, before the join, so the join has at most that many rows per query.
    most = queries.agg(F.max("limit")).first()[0] or 0
    hits = top_per_group(live, on, [F.desc("last_seen_at"), F.asc(tie)], most, "rank").join(queries, list(on))
    return hits.filter(F.col("rank") <= F.col("limit")).select(*[c for c in hits.columns if c != "rank"], "rank")


def lookup_live(listings: DataFrame, queries: DataFrame, now: Column, tie: str = "external_id") -> DataFrame:
    """Live listings per query with the same role and location, newest first, as many as its ``limit``.

    ``queries`` has one row per query; a null limit gives no rows.
    """
    return _newest(listings.filter(is_live(now)), queries, ["normalized_role", "location_query"], tie)


def lookup_live_any_location(listings: DataFrame, queries: DataFrame, now: Column, tie: str = "external_id") -> DataFrame:
    """As :func:`lookup_live` without the location, for a wider sample: six times the limit, 140 at least."""
    wide = queries.drop("location_query").withColumn("limit", F.greatest(F.col("limit") * 6, F.lit(CANDIDATE_LIMIT)))
    return _newest(listings.filter(is_live(now)), wide, ["normalized_role"], tie)


def upsert_listings(
    target: DataFrame, batch: DataFrame, now: Column, dedupe_on: Sequence[str], arrival: str = "arrival",
    ttl_minutes: int = TTL_MINUTES, key: Sequence[str] = ("source", "external_id"),
) -> DataFrame:
    """Target with the batch inserted or updated; the batch is deduplicated first (first arrival wins).

    One aggregation by key picks the newest row, of equally new ones the greatest by its columns (title and url first),
    and keeps the first ``created_at``.
    Partial results merge before the shuffle, so many versions of one key are cheap.
    """
    fresh = first_per_key(batch, list(dedupe_on), [F.asc(arrival)]).drop(arrival)
    fresh = fresh.withColumns(
        {"last_seen_at": now, "created_at": now, "cached_until": now + F.make_dt_interval(mins=F.lit(ttl_minutes))}
    )
    both = target.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "created_at")]
    first = [c for c in ("last_seen_at", "title", "url") if c in rest]
    ordered = first + [c for c in rest if c not in first and "map<" not in both.schema[c].dataType.simpleString()]
    newest = F.max_by(F.struct(*rest), F.struct(*ordered))
    merged = both.groupBy(*key).agg(newest.alias("row"), F.min("created_at").alias("created_at"))
    return merged.select(*key, *[F.col(f"row.{c}").alias(c) for c in rest], "created_at")


def expire_and_cap(df: DataFrame, now: Column, stored_at: str, ttl_minutes: int, max_entries: int, tie: str) -> DataFrame:
    """Entries younger than the TTL; the newest ``max_entries`` of them (a bounded sort, no window)."""
    young = df.filter(now - F.col(stored_at) < F.make_dt_interval(mins=F.lit(ttl_minutes)))
    return young.orderBy(F.desc(stored_at), F.asc(tie)).limit(max_entries)


def needs_profile_refresh(version: Column, skills: Column, weights: Column, evidence: Column, mode: Column, source: Column) -> Column:
    """Profile is old, incomplete or from a mode that is not current; baseline rows never are."""
    missing = (F.coalesce(F.size(skills), F.lit(0)) <= 0) | (F.coalesce(F.size(weights), F.lit(0)) <= 0) | (F.coalesce(F.size(evidence), F.lit(0)) <= 0)
    stale = F.coalesce(version, F.lit(0)) < PROFILE_VERSION
    return (source != "role-baseline") & (stale | missing | ~F.coalesce(mode, F.lit("")).isin(*CURRENT_MODES))


def delete_cascade(
    runs: DataFrame, docs: DataFrame, users: DataFrame, run_keys: DataFrame | None = None, user_keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, docs, users) without the given runs and users and without the documents they used."""
    kept = runs
    if run_keys is not None:
        kept = kept.join(run_keys, ["user_id", "run_id"], "left_anti")
    if user_keys is not None:
        kept = kept.join(user_keys, ["user_id"], "left_anti")
        users = users.join(user_keys, ["user_id"], "left_anti")
    gone = runs.select("run_id", "doc_id").join(kept.select("run_id"), ["run_id"], "left_anti").select("doc_id").distinct()
    return kept, docs.join(gone, ["doc_id"], "left_anti"), users


def nest_report(runs: DataFrame, details: DataFrame, kinds: Sequence[str], max_items: int = 20) -> DataFrame:
    """One nested row per run: its detail rows as one array per kind, best share first.

    ``max_items`` is the report's own length; groups are cut to it before collecting.
    """
    order = [F.desc("share"), F.asc("term")]
    top = top_per_group(details, ["run_id", "kind"], order, max_items, "pos")
    item = F.struct("pos", "term", "share")
    arrays = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))).alias(f"{k}_terms") for k in kinds]
    return runs.join(top.groupBy("run_id").agg(*arrays), ["run_id"], "left")


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write the nested report; Parquet or JSON lines."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
