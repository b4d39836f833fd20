"""Queries on pairs take every row of their tables."""

from pyspark.sql import functions as F

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def test_every_document_meets_every_listing_of_its_query(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    count = lambda df, key: {r[0]: r[1] for r in df.groupBy(key).agg(F.count("*")).collect()}
    orders = count(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderpriority")
    documents = [r[0] for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect()]
    got = count(queries()["M4_semantic_relevance"](spark, folder), "doc_id")
    assert got == {d: orders[PRIORITIES[d % 5]] for d in documents} and len(got) == 150
