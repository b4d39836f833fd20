"""What one task holds does not grow with the tables."""

from pyspark.sql import functions as F

from docmarket.operators import market as K
from docmarket.sources import tables

FOLDER = "/root/testdata/sf0.01"


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(10_000).withColumn("key", F.col("id") % 500)
    assert tables.deal(df, 4 * tables.ROWS_PER_TASK, "key").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    many = tables.deal(df, 9 * tables.ROWS_PER_TASK + 1, "key")
    assert many.rdd.getNumPartitions() == 10
    assert many.select("key", F.spark_partition_id().alias("p")).distinct().count() == 500


def test_terms_of_a_listing_in_one_sort(spark):
    rows = [("q", 1, "b", 0.5, 2), ("q", 1, "a", None, 7), ("q", 1, "a", 0.25, 3), ("q", 1, None, 1.0, 1), ("q", 1, None, None, 4), ("r", 1, "a", None, 1), (None, 2, "c", 0.1, 1), (None, 2, "c", 0.2, 0)]
    terms = spark.createDataFrame(rows, "query_id string, listing_id int, term string, weight double, n_evidence int")
    once = K.listing_terms(terms, "weight", "n_evidence")
    want = terms.groupBy("query_id", "listing_id", "term").agg(F.max("weight").alias("weight"), F.max("n_evidence").alias("n_evidence"))
    key = lambda r: str(tuple(r))
    assert sorted(once.drop("lead").collect(), key=key) == sorted(want.collect(), key=key)
    assert sorted(once.filter("lead").groupBy("query_id", "listing_id").count().collect(), key=key) == sorted([("q", 1, 1), ("r", 1, 1), (None, 2, 1)], key=key)
    assert once._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_market_is_dealt_by_listing(spark, monkeypatch):
    from docmarket.catalog import gaps, market

    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "ROWS_PER_TASK", lines // 50)
    listings, terms, hints = market.market_frames(spark, FOLDER)
    assert terms.rdd.getNumPartitions() == 51 or lines % 50 == 0
    # Rows of a query never meet in one task: no listing is shuffled by its query alone.
    plan = K.term_demand(listings, terms, hints)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("hashpartitioning(query_id", plan.index("primary")):] if "primary" in plan else plan
    assert "REPARTITION_BY_NUM" in below
    assert gaps.doc_terms(spark, FOLDER).rdd.getNumPartitions() > 4


def test_changes_to_demand_are_dealt_by_listing(spark, monkeypatch):
    from docmarket.catalog import refresh
    from docmarket.operators import demand_state as D

    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    monkeypatch.setattr(tables, "ROWS_PER_TASK", lines // 50)
    seen, inner = [], D.demand_rows

    def spy(listings, terms, *args, **named):
        seen.append((listings, terms))
        return inner(listings, terms, *args, **named)

    monkeypatch.setattr(D, "demand_rows", spy)
    refresh.k1_refreshes(spark, FOLDER)
    assert len(seen) == 3  # the state and two changes, each in one pass
    assert all(df.rdd.getNumPartitions() in (50, 51) for both in seen for df in both)
    # Terms of a listing and the listing meet as they were dealt.
    listings, terms = seen[0]
    plan = K.listing_terms(terms, "weight").join(listings, ["query_id", "listing_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_pairs_are_scored_where_they_are_made(spark):
    import random

    from docmarket.operators import scoring as M

    rng = random.Random(5)
    docs = spark.createDataFrame([(d, f"q{d % 3}", float(d)) for d in range(12)], "doc_id int, query_id string, language double")
    listings = spark.createDataFrame([(f"q{i % 3}", i, float(i), float(i % 30), float(i % 14)) for i in range(40)], "query_id string, listing_id int, base double, title_alignment double, role_fit double")
    terms = spark.createDataFrame([(f"q{i % 3}", i, f"t{rng.randrange(9)}") for i in range(36) for _ in range(rng.randrange(1, 6))], "query_id string, listing_id int, term string")
    proofs = spark.createDataFrame([(d, f"t{n}", rng.choice((1.0, 0.72, 0.38))) for d in range(10) for n in rng.sample(range(9), 4)], "doc_id int, term string, proof double")
    relevant = spark.createDataFrame([(d, f"t{rng.randrange(9)}") for d in range(11) for _ in range(3)], "doc_id int, term string")
    got = M.market_relevance(docs, listings, terms, proofs, relevant, 5)
    want = M.semantic_relevance(docs.join(listings, ["query_id"]), terms, proofs, relevant)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 160
    # No step after the join of documents and listings moves a pair.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" not in plan.split("Join Inner")[0]


def test_proofs_are_looked_up_in_the_document(spark):
    from docmarket.catalog import gaps
    from docmarket.operators import gaps as L, terms as E

    demand = gaps.shared_demand(spark, FOLDER)
    proved = gaps.proved_frame(spark, FOLDER, demand)
    own = gaps.doc_terms(spark, FOLDER)
    support = own.select("doc_id", "term", F.when(F.col("qty") >= 40, "strong").when(F.col("qty") >= 20, "medium").otherwise("weak").alias("level"))
    joined = gaps.with_required(E.with_proof(gaps.doc_queries(spark, FOLDER).join(gaps.top_demand(demand), ["query_id"]), own, support, "doc_id"))
    cols = ["doc_id", "term", "proof", "required", "has_term"]
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(proved, *cols) == rows(joined, *cols)
    matched, missing = L.split_matched(proved)
    both = matched.withColumn("status", F.lit("matched")).select("doc_id", "term", "status").union(missing.select("doc_id", "term", "signal_source"))
    assert rows(L.match_status(proved), "doc_id", "term", "status") == rows(both, "doc_id", "term", "status")
    # The documents of a query are not brought together.
    plan = proved.select(*cols)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [query_id" not in plan and "SortMergeJoin [doc_id" not in plan.split("BroadcastHashJoin [query_id")[0]
