"""Structured Streaming jobs: listing ingest, deduplication, demand over time, attempt roll-up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as TY
from pyspark.sql.streaming import StreamingQuery

from docmarket import lexicons as X
from docmarket.functions import text as T
from docmarket.session import cut_lineage

# --- fixed values -------------------------------------------------------------
LATENESS = "360 minutes"
DEMAND_WINDOW = "6 hours"
SKETCH_BITS = 14
# ------------------------------------------------------------------------------


def read_landed(spark: SparkSession, folder: str, schema: TY.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files landing in a folder as a stream; the schema is declared, never inferred."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def ingest_listings_stream(
    stream: DataFrame, target: str, checkpoint: str, schema: TY.StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], key: Sequence[str], buckets: int = 64
) -> StreamingQuery:
    """Merge each batch of landed listings into a Parquet table partitioned by a hash bucket of its key.

    ``schema`` is that of the table without the bucket; ``merge(before, batch)`` is the batch upsert. A
    batch reads and overwrites only the buckets it touches. The merged rows are checkpointed before
    they are written, as they are read from the table they replace; if a batch is run again after a
    failure, an upsert that is ordered by its rows gives the same rows again.
    """
    placed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    full = TY.StructType([*schema.fields, TY.StructField("bucket", TY.IntegerType())])
    stream.sparkSession.createDataFrame([], full).write.mode("ignore").partitionBy("bucket").parquet(target)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = placed(batch).persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        before = batch.sparkSession.read.schema(full).parquet(target).filter(F.col("bucket").isin(touched))
        merged = cut_lineage(placed(merge(before.drop("bucket"), rows.drop("bucket"))).repartition("bucket"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(stream: DataFrame, key: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """First sighting of a key; the state of a key is dropped once the watermark passes it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def demand_over_time(df: DataFrame, ts: str, term: str, source: Column, weight: Column, window: str = DEMAND_WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Trust-weighted mentions per term and tumbling window; works on a stream and, unchanged, on a batch."""
    trust = F.coalesce(F.try_element_at(T.lit_map(X.DEMAND_TRUST), F.lower(source)), F.lit(X.DEMAND_TRUST_OTHER))
    rows = df.withWatermark(ts, lateness) if df.isStreaming else df
    agg = rows.groupBy(F.window(ts, window).alias("w"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("mentions"), F.sum(trust * weight).alias("weighted"))
    return agg.select(F.col("w.start").alias("window_start"), "term", "mentions", F.round("weighted", 4).alias("weighted"))


def attempt_rollup_stream(df: DataFrame, ts: str = "ts", window: str = DEMAND_WINDOW, lateness: str = LATENESS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Attempt counts per source and window, with a mergeable sketch of the distinct queries; stream or batch.

    A stream needs bounded state, so distinct queries are kept as a sketch of ``2**sketch_bits`` registers:
    ``queries`` is its estimate, with a relative standard error of about ``0.83 / sqrt(2**sketch_bits)``,
    0.65 % at 14. Attempts later than ``lateness`` are dropped by the watermark.
    """
    rows = df.withWatermark(ts, lateness) if df.isStreaming else df
    error = F.coalesce("error", F.lit(""))
    agg = rows.groupBy(F.window(ts, window).alias("w"), "source").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(error != "").alias("errors"),
        F.count_if(F.contains(F.lower(error), F.lit("timeout"))).alias("timeouts"), F.sum("result_count").alias("raw_returned"),
        F.max(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))).alias("max_elapsed_ms"), F.hll_sketch_agg(F.col("query").cast("string"), sketch_bits).alias("query_sketch"),
    )
    return agg.select(
        F.col("w.start").alias("window_start"), "source", "requests", "successes", "errors", "timeouts", "raw_returned", "max_elapsed_ms",
        F.hll_sketch_estimate("query_sketch").alias("queries"), "query_sketch",
    )


def attempt_totals(windows: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Roll windows up further: counts add, sketches merge, so a query seen in many windows counts once."""
    sums = [F.sum(c).alias(c) for c in ("requests", "successes", "errors", "timeouts", "raw_returned")]
    out = windows.groupBy(*by).agg(*sums, F.max("max_elapsed_ms").alias("max_elapsed_ms"), F.hll_union_agg("query_sketch").alias("query_sketch"))
    return out.withColumn("queries", F.hll_sketch_estimate("query_sketch"))
