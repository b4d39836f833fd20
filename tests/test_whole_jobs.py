"""Long lists, long phrases and long texts, which a limit would cut."""

import random

from pyspark.sql import functions as F

from docmarket.operators import alignment as G, dedupe as D, requirements as Q, scoring as M, terms as E
from docmarket.sources import feeds


def scan(rows, limit):
    kept = []
    for row in sorted(rows):
        if len(kept) < limit and not any(row[2] == k[2] or row[3] == k[3] for k in kept):
            kept.append(row)
    return kept


def test_merge_ranked_of_long_lists(spark):
    rng = random.Random(5)
    lists = {q: [(o, i, f"k{int(n * rng.random() ** 4)}", f"s{int(n * rng.random() ** 4)}") for o in (0, 1) for i in range(size)] for q, n, size in ((1, 9000, 9000), (2, 30, 400), (3, 6, 400))}
    frame = lambda origin: spark.createDataFrame([(q, i, k, s) for q, rows in lists.items() for o, i, k, s in rows if o == origin], "query_id int, rank int, key string, signature string")
    for limit in (4, 10):
        got = D.merge_ranked(frame(0), frame(1), limit).collect()
        for q, rows in lists.items():
            assert sorted((r["position"], r["origin"], r["rank"], r["key"], r["signature"]) for r in got if r["query_id"] == q) == [(p + 1, *r) for p, r in enumerate(scan(rows, limit))]


def test_phrases_of_more_than_four_words(spark):
    lexicon = spark.createDataFrame([("sql", "sql")], "term string, surface string")
    texts = spark.createDataFrame([(1, "we want end to end load test owners"), (2, "end to end load")], "id int, text string")
    wanted = texts.select("id", F.lit("end to end load test owners").alias("term"))
    assert [tuple(r) for r in E.targeted_evidence(texts, ["id"], "text", lexicon, wanted).collect()] == [(1, "end to end load test owners", "literal")]
    table = spark.createDataFrame([("head of end to end load", "etl", 0.5)], "phrase string, term string, weight double")
    titles = spark.createDataFrame([(1, "The head of end to end load"), (2, "head of end to end")], "id int, title string")
    assert [tuple(r) for r in Q.title_implied(titles, "id", "title", table).collect()] == [(1, "etl", 0.5, 1)]


def test_words_far_into_a_description_count(spark):
    long = "filler " * 900 + "zebra keeper"
    row = spark.createDataFrame([("zebra keeper", "Wanted", ["x"], long)], "q_text string, title string, tags array<string>, description string")
    assert row.select(G.fast_title_alignment()).first()[0] > row.select(G.fast_title_alignment(240)).first()[0] == 0
    whole = feeds.prepare_listing_text(row.select("description")).first()
    assert whole["description"] == long and len(whole["preview"]) <= 260


def test_runs_of_tokens_stay_in_the_row(spark):
    lexicon = spark.createDataFrame([("sql", "sql")], "term string, surface string")
    texts = spark.createDataFrame([(1, "we know SQL and micro services well"), (1, "sql again"), (2, "o f all"), (3, None)], "id int, text string")
    wanted = spark.createDataFrame([(i, t) for i in (1, 2, 3) for t in ("sql", "microservices", "of", "cobol")], "id int, term string")
    out = E.targeted_evidence(texts, ["id"], "text", lexicon, wanted.union(wanted))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "microservices", "literal"), (1, "sql", "pattern"), (2, "of", "literal")]
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in joins and joins.count("explode") + joins.count("Generate") <= 4


def test_skill_match_without_pairs_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    listings = [(f"q{i % 3}", i, rng.choice(("live", "role-baseline"))) for i in range(90)]
    terms = [(q, i, f"t{n}", rng.choice((None, 0.3, 0.9, 1.0))) for q, i, _ in listings for n in rng.sample(range(12), rng.randrange(0, 6))]
    proofs = [(d, f"t{n}", rng.choice((1.0, 0.72, 0.38))) for d in range(40) for n in rng.sample(range(12), rng.randrange(0, 7))]
    docs = spark.createDataFrame([(d, f"q{d % 4}") for d in range(40)], "doc_id int, query_id string")
    listings = spark.createDataFrame(listings, "query_id string, listing_id int, source string")
    terms = spark.createDataFrame(terms, "query_id string, listing_id int, term string, weight double")
    proofs = spark.createDataFrame(proofs, "doc_id int, term string, proof double")
    pairs = docs.join(listings, ["query_id"]).join(terms, ["query_id", "listing_id"]).join(proofs, ["doc_id", "term"], "left").fillna(0.0, ["proof"])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(M.market_skill_match(docs, listings, terms, proofs))
    assert len(got) == 30 and got == rows(M.skill_match(pairs))


def test_listings_of_a_query_are_all_scored(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    orders = {r["o_orderpriority"]: r["n"] for r in spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()}
    asked = spark.read.parquet(f"{folder}/customer.parquet").filter("c_custkey % 100 = 0").select("c_custkey").collect()
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    want = {r[0]: orders[priorities[r[0] % 5]] for r in asked}
    got = {r["doc_id"]: r["n"] for r in queries()["M4_semantic_relevance"](spark, folder).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want and want
