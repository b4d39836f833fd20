"""From raw documents to shards: classify, drop near copies, drop benchmark leaks, mix sources, shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmarket.llm import decontamination, importance, jaccard_join, mixing, sharding
from docmarket.llm.words import small_batches
from docmarket.session import cut_lineage, new_folder

#: The classifier's model and the Gumbel sample have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = importance.train_classifier(docs, labels)
    return importance.classify(docs, classifier, keep_text=True).filter("__kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8: that with the smallest id.

    Documents without an id cannot be told apart and stay; of rows that repeat an id one stays.
    """
    small_batches(spark)
    groups = cut_lineage(jaccard_join.jaccard_components(docs, shingle=5, percent=80))
    first = cut_lineage(groups.filter("doc_id = component_id").groupBy("doc_id").count())
    number = first.count()
    held = lambda rows: docs.join(jaccard_join.small(first.filter(rows).select("doc_id"), number), "doc_id", "left_semi")
    kept = held("count = 1").unionByName(held("count > 1").dropDuplicates(["doc_id"]))
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    small_batches(spark)
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=True)
    return found.filter(F.size("spans") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    keyed = mixing.mix_keys(docs)
    sizes = cut_lineage(keyed.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")))
    taken = mixing.apply_mix(keyed, mixing.plan_mix(sizes)).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return sharding.shard_documents(docs)


STAGES = [("quality classifier", classify_quality), ("near copies", drop_near_copies), ("benchmark leaks", drop_leaks), ("source mix", mix), ("shards", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
