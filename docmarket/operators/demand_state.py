"""Term demand kept up to date over refreshes: mergeable sums that only changed listings touch."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmarket import lexicons as X
from docmarket.operators.market import BASELINE_DAMPING, demand_pairs, is_live_source, job_columns, term_weight
from docmarket.session import cut_lineage
from docmarket.sources import tables

EXACT = "decimal(38,12)"  # sums of fixed-point numbers do not depend on order, and what is taken away leaves nothing
KEYS = ("kind", "bucket", "query_id", "term", "company", "source", "live", "primary", "hinted", "signature")
SUMS = ("weighted", "jobs", "n", "n_live")


def demand_rows(
    listings: DataFrame, terms: DataFrame, hints: DataFrame, sign: int | Column = 1, buckets: int = 64, trust_table: Mapping[str, float] = X.DEMAND_TRUST,
    trust_other: float = X.DEMAND_TRUST_OTHER, generic: Sequence[str] = X.GENERIC_SECONDARY_TERMS,
) -> DataFrame:
    """What listings add to the state (``sign`` 1) or take from it (-1). Inputs as for ``term_demand``, with ``signature``.

    ``sign`` may be a column of the listings: a changed listing then has two rows, and its terms are read once for both.

    Three kinds of rows: ``term`` has the weighted sum, the job weights of leading rows and the count by (query, term,
    company, source, signature); ``query`` the listings and live listings of a query; ``copies`` the listings of a
    signature. Job weights are neither damped nor divided by copies here: both may change for listings that do not.
    """
    listings = listings.withColumn("sign", F.lit(sign))
    jobs = listings.select("query_id", "listing_id", "signature", "sign", *[c.alias(n) for n, c in job_columns(trust_table, trust_other).items()])
    add = lambda c, name: F.sum((c * F.col("sign")).cast(EXACT)).cast(EXACT).alias(name)
    pairs = demand_pairs(jobs, terms, hints)
    by_term = pairs.groupBy("query_id", "term", "company", "source", "live", "primary", "hinted", "signature").agg(
        add(F.col("job_weight") * term_weight(generic), "weighted"), add(F.when(F.col("lead"), F.col("job_weight")).otherwise(0.0), "jobs"), F.sum("sign").alias("n")
    )
    live = is_live_source(F.col("source"))
    by_query = listings.groupBy("query_id").agg(F.sum("sign").alias("n"), F.sum(F.when(live, F.col("sign")).otherwise(0)).alias("n_live"))
    copies = listings.groupBy("signature").agg(F.sum("sign").alias("n"))
    parts = [by_term.withColumn("kind", F.lit("term")), by_query.withColumn("kind", F.lit("query")), copies.withColumn("kind", F.lit("copies"))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    # Rows that one change touches lie in few buckets: a query's, and a signature's.
    bucket = F.pmod(F.when(F.col("kind") == "copies", F.xxhash64("signature")).otherwise(F.xxhash64("query_id")), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).select(*KEYS, *[F.coalesce(c, F.lit(0).cast(EXACT if c in ("weighted", "jobs") else "bigint")).alias(c) for c in SUMS])


def merge_demand(*parts: DataFrame) -> DataFrame:
    """States and changes to states added up; what has come to nothing is dropped."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    merged = rows.groupBy(*KEYS).agg(*[F.sum(c).cast(EXACT if c in ("weighted", "jobs") else "bigint").alias(c) for c in SUMS])
    return merged.filter("n <> 0")


def create_state(rows: DataFrame, folder: str) -> None:
    """Write a first state, one folder for each bucket."""
    merge_demand(rows).write.partitionBy("bucket").parquet(folder)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def refresh_state(spark: SparkSession, folder: str, change: DataFrame) -> None:
    """Add a change to the state in ``folder``. Only buckets that the change touches are read and written again."""
    change = cut_lineage(change)
    touched = [r["bucket"] for r in change.select("bucket").distinct().collect()]  # at most as many as there are buckets
    if not touched:
        return
    old = read_state(spark, folder).filter(F.col("bucket").isin(touched))
    merged = cut_lineage(merge_demand(old.select(*KEYS, *SUMS), change))
    # A bucket that comes to nothing has no rows to replace it with; one row that counts nothing keeps it.
    empty = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        *[(F.lit("none") if c == "kind" else F.col("bucket") if c == "bucket" else F.lit(None)).cast(merged.schema[c].dataType).alias(c) for c in KEYS],
        *[F.lit(0).cast(merged.schema[c].dataType).alias(c) for c in SUMS],
    )
    # All rows of a query lie in one bucket: more of them than a task should sort are dealt to several, each with a file of its own.
    slices = math.ceil(merged.count() / tables.ROWS_PER_TASK) or 1
    dealt = merged.unionByName(empty).repartition("bucket", F.pmod(F.xxhash64("term", "company", "signature"), F.lit(slices)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def demand_of(state: DataFrame) -> DataFrame:
    """The demand table of a state, as ``term_demand`` gives it for the listings that are in."""
    kind = lambda name: state.filter(F.col("kind") == name)
    copies = kind("copies").select(F.col("signature").alias("__signature"), F.col("n").alias("__copies"))
    queries = kind("query").select(F.col("query_id").alias("__query"), (F.col("n_live") > 0).alias("live_present"), F.col("n_live").alias("live_listings"))
    rows = kind("term").join(copies, F.col("signature").eqNullSafe(F.col("__signature")))
    single = {c: F.col(c).cast("double") / F.greatest("__copies", F.lit(1)) for c in ("weighted", "jobs")}
    # The row of a query meets sums without signatures: it would bring all the query's rows of the state together in one task.
    small = rows.withColumns(single).groupBy("query_id", "term", "company", "source", "live").agg(
        F.sum("weighted").alias("weighted"), F.sum("jobs").alias("jobs"), F.sum("n").alias("n"), F.sum(F.when(F.col("live"), F.col("n")).otherwise(0)).alias("n_live"), *[F.max(c).alias(c) for c in ("primary", "hinted")]
    )
    damping = F.when(F.col("live_present") & ~F.col("live"), BASELINE_DAMPING).otherwise(1.0)
    scaled = small.join(queries, F.col("query_id").eqNullSafe(F.col("__query"))).withColumns({c: F.col(c) * damping for c in ("weighted", "jobs")})
    demand = scaled.groupBy("query_id", "term").agg(
        F.sum("weighted").alias("weighted"), F.sum("jobs").alias("jobs"), F.sum("n").alias("count"), F.sum("n_live").alias("live_count"), *[F.max(c).alias(c) for c in ("primary", "hinted", "live_present", "live_listings")],
        F.count_distinct("company").alias("company_count"), F.count_distinct("source").alias("source_count"),
    )
    out = demand.withColumn("total", F.sum("jobs").over(Window.partitionBy("query_id"))).filter("total > 0")
    return out.withColumn("share", F.round(F.col("weighted") / F.col("total") * 100, 1)).drop("weighted", "jobs", "total")
