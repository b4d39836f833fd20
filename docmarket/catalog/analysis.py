"""The end-to-end plan on the tables: conversation turns are documents, parts are listings, with the texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog.requirements import LEX as REQ
from docmarket.catalog.roles import LEX as ROLES, parts_frame
from docmarket.catalog.structure import HEADERS
from docmarket.catalog.terms import lexicon
from docmarket.functions import text as T
from docmarket.plans.analysis import Analysis, Market, analyse_market, run_analysis
from docmarket.registry import query
from docmarket.sources.tables import table


def market_inputs(spark, sf):
    """(docs, listings, queries): the query is the name of a part; a listing is asked for by the next part's name.

    Parts are numbered without a gap. Documents and conversations are dealt to them round and round by
    their number, the last part's name asks for the first part, and a part without a document has an empty text.
    """
    key = F.col("p_partkey")
    number, first = table(spark, sf, "part").agg(F.greatest(F.count(F.lit(1)), F.lit(1)), F.coalesce(F.min(key), F.lit(0))).first()
    dealt = lambda n: (F.pmod(F.coalesce(n, F.lit(0)) - first, F.lit(number)) + first).cast("bigint")
    names = table(spark, sf, "part").select(dealt(key + 1).alias("p_partkey"), F.col("p_name").alias("query_id"))
    texts = table(spark, sf, "documents").groupBy(dealt(F.col("doc_id")).alias("p_partkey")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("texts"), F.sort_array(F.collect_set("lang")).alias("langs")
    )
    listings = parts_frame(spark, sf).join(names, ["p_partkey"]).join(texts, ["p_partkey"], "left").select(
        "query_id", key.alias("listing_id"), F.element_at(T.lit_array(("jobicy", "adzuna", "remoteok")), (key % 3 + 1).cast("int")).alias("source"), F.col("p_brand").alias("company"),
        F.col("label").alias("title"), F.coalesce(F.array_join("texts.text", "\n"), F.lit("")).alias("description"), F.concat(F.array("p_type"), F.coalesce("langs", T.lit_array([]))).alias("tags"),
        F.lit("Remote").alias("location"), F.lit(True).alias("remote"),
    )
    queries = names.select("query_id").distinct().select("query_id", F.col("query_id").alias("q_text"), F.lit("").alias("q_location"), F.lit(15).alias("limit"))
    turns = table(spark, sf, "conversations").withColumn("p_partkey", dealt(F.col("conv_id") + 1))
    docs = turns.join(names, ["p_partkey"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "query_id", "text", F.lit("text/plain").alias("content_type"))
    return docs, listings, queries


def analysis(spark, sf) -> Analysis:
    docs, listings, queries = market_inputs(spark, sf)
    return run_analysis(docs, listings, queries, lexicon(spark), ROLES, HEADERS, F.lit("2024-05-17").cast("date"), REQ)


def market(spark, sf) -> Market:
    """The listings' side, which needs no document."""
    _, listings, queries = market_inputs(spark, sf)
    return analyse_market(listings, queries, lexicon(spark), ROLES, REQ)


@query("analysis_selected_listings")
def selected(spark, sf):
    return market(spark, sf).selected


@query("analysis_demand")
def demand(spark, sf):
    return market(spark, sf).demand.select("query_id", "term", "share", "rank")


@query("analysis_scores")
def scores(spark, sf):
    return analysis(spark, sf).scores
