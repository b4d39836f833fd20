"""The market of the end-to-end plan has all rows of its tables."""

from pyspark.sql import functions as F

from docmarket.catalog.analysis import market_inputs
from docmarket.sources.tables import table


def test_all_parts_documents_and_turns_take_part(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs, listings, queries = market_inputs(spark, sf)
        parts = table(spark, sf, "part").count()
        assert listings.count() == listings.select("listing_id").distinct().count() == parts
        assert docs.count() == table(spark, sf, "conversations").count()
        size = F.sum(F.length(F.regexp_replace("text", "\n", "")))
        assert listings.select(F.regexp_replace("description", "\n", "").alias("text")).agg(size).first() == table(spark, sf, "documents").agg(size).first()
        assert listings.join(queries, ["query_id"], "left_anti").isEmpty() and listings.filter("description IS NULL").isEmpty()
