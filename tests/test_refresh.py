"""Refreshes against full recomputation, and what they leave untouched."""

import os
import random
from functools import reduce

import pytest

from pyspark.sql import functions as F

from docmarket.operators import demand_state as D, market as K, profile_table as P
from docmarket.operators.requirements import RequirementLexicon
from docmarket.sources import tables
from docmarket.sources.listings import PROFILE_VERSION
from docmarket.sources.tables import values_frame

LISTING = "query_id string, listing_id int, source string, company string, title string, role_fit double, listing_quality double, signature string"
TERM = "query_id string, listing_id int, term string, weight double, n_evidence int"


def market(rng, ids):
    listings, terms = [], []
    for i in ids:
        query = f"q{i % 4}"
        source = rng.choice(["jobicy", "Adzuna", "role-baseline", "other"])
        listings.append((query, i, source, rng.choice(["Acme", " acme ", "", None, "Bolt"]), rng.choice(["spark lead", "SQL dev", ""]), rng.choice([None, 1.0, 9.5]), rng.choice([None, 0.0, 25.0]), rng.choice(["s1", "s2", None, f"own {i}"])))
        terms += [(query, i, t, rng.choice([None, 0.4, 1.0]), rng.randint(0, 3)) for t in rng.sample(["spark", "sql", "docker", "excel"], rng.randint(0, 3))]
    return listings, terms


def test_demand_equals_recomputation(spark, tmp_path):
    rng = random.Random(4)
    hints = spark.createDataFrame([("q0", "spark", "primary"), ("q1", "sql", "market"), ("q2", "excel", "primary")], "query_id string, term string, kind string")
    held: dict[int, tuple] = {}

    def frames(ids, pool):
        return spark.createDataFrame([pool[i][0] for i in ids], LISTING), spark.createDataFrame([t for i in ids for t in pool[i][1]], TERM)

    def versions(ids):
        listings, terms = market(rng, ids)
        return {l[1]: (l, [t for t in terms if t[1] == l[1]]) for l in listings}

    rows = lambda ids, pool, sign=1: D.demand_rows(*frames(ids, pool), hints, sign, buckets=8)
    held = versions(range(120))
    folder = str(tmp_path / "state")
    D.create_state(rows(list(held), held), folder)
    # Inserts, expiries and changed listings; then a query whose listings all go.
    for gone, new in ((list(range(0, 30)) + [40, 41], list(range(200, 240)) + [40, 41]), ([i for i in range(30, 120) if i % 4 == 3 and i != 41] + [i for i in range(200, 240) if i % 4 == 3] + [], [300])):
        gone = [i for i in gone if i in held]
        fresh = versions(new)
        D.refresh_state(spark, folder, rows(gone, held, -1).unionByName(rows(list(fresh), fresh)))
        for i in gone:
            del held[i]
        held |= fresh
        want = K.term_demand(*frames(list(held), held), hints)
        got = D.demand_of(D.read_state(spark, folder)).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    rng = random.Random(6)
    hints = spark.createDataFrame([], "query_id string, term string, kind string")
    listings, terms = market(rng, range(400))
    listings = [(f"q{l[1]}", *l[1:]) for l in listings]
    terms = [(f"q{t[1]}", *t[1:]) for t in terms]
    folder = str(tmp_path / "state")
    rows = lambda some, sign=1: D.demand_rows(spark.createDataFrame(some, LISTING), spark.createDataFrame(terms, TERM), hints, sign, buckets=64)
    D.create_state(rows(listings), folder)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}
    before = files()
    D.refresh_state(spark, folder, rows(listings[:1], -1))
    after = files()
    assert 0 < len({os.path.dirname(f) for f in after - before}) <= 2  # the query's bucket and the signature's
    D.refresh_state(spark, folder, rows(listings[:1]).limit(0))
    assert files() == after
    # Taking everything away leaves nothing.
    D.refresh_state(spark, folder, rows(listings[1:], -1))
    assert D.read_state(spark, folder).filter("kind <> 'none'").count() == 0
    D.refresh_state(spark, folder, rows(listings[:1]))
    assert D.read_state(spark, folder).filter("kind = 'query'").count() == 1


def test_rows_of_a_query_are_not_brought_together(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    hints = spark.createDataFrame([], "query_id string, term string, kind string")
    listings, terms = market(rng, range(400))
    listings, terms = [("q", *l[1:]) for l in listings], [("q", *t[1:]) for t in terms]
    folder = str(tmp_path / "state")
    rows = lambda some: D.demand_rows(spark.createDataFrame(some, LISTING), spark.createDataFrame(terms, TERM), hints, buckets=8)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks stay apart
    try:
        D.create_state(rows(listings[:300]), folder)
        D.refresh_state(spark, folder, rows(listings[300:]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state = D.read_state(spark, folder)
    assert state.filter("kind = 'term'").select(F.input_file_name()).distinct().count() > 1
    got = D.demand_of(state)
    want = K.term_demand(spark.createDataFrame(listings, LISTING), spark.createDataFrame(terms, TERM), hints)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # The row of a query meets sums: its join stands above the sums without signatures, the join with the copies below.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i in range(len(plan)) if plan.startswith("Join Inner", i)]
    assert len(joins) == 2 and "Aggregate [query_id" in plan[joins[0]:joins[1]]


PROFILE = "content_hash string, terms array<string>, weights map<string,double>, evidence array<struct<term:string,snippet:string>>, quality double, mode string, version int"
JOB = "id int, source string, title string, description string, tags array<string>, extras map<string,string>"


@pytest.fixture()
def builder(spark):
    lexicon = values_frame(spark, ["surface", "term"], [("spark", "spark"), ("apache spark", "spark"), ("sql", "sql")])
    parsed = []
    inner = P.lexicon_builder(lexicon, RequirementLexicon())

    def build(texts):
        parsed.append([r["title"] for r in texts.select("title").collect()])
        return inner(texts)

    return build, parsed


def test_known_texts_are_not_parsed_again(spark, builder):
    build, parsed = builder
    jobs = [(1, "feed", "Spark lead", "Apache Spark is required. Nice to have: SQL.", ["x"], {"salary": "9", "skills": "old"}), (2, "feed", "Spark lead", "Apache Spark is required. Nice to have: SQL.", ["x"], {}), (3, "feed", "Cook", "No such words.", None, {}), (4, "role-baseline", "Base", "spark", [], {"skills": "kept"}), (5, "feed", None, None, None, {"a": "b"})]
    listings = spark.createDataFrame(jobs, JOB)
    first = P.refresh_profiles(listings, spark.createDataFrame([], PROFILE), build).cache()
    assert sorted(str(t) for t in parsed[0]) == ["Cook", "None", "Spark lead"]  # copies once, no baseline
    rows = {r["content_hash"]: r for r in first.collect()}
    assert len(rows) == 3 and all(r["version"] == PROFILE_VERSION for r in rows.values())
    spark_row = next(r for r in rows.values() if r["terms"])
    assert spark_row["terms"] == ["spark", "sql"] and spark_row["weights"]["spark"] >= 0.88 and {e["term"] for e in spark_row["evidence"]} == {"spark", "sql"}
    # Again, with one changed text: only that one and those without terms are parsed.
    changed = spark.createDataFrame([*jobs[1:], (1, "feed", "SQL dev", "sql required", ["x"], {"salary": "9", "skills": "old", "normalization_version": "1"})], JOB)
    parsed.clear()
    second = P.refresh_profiles(changed, first, build).cache()
    assert second.count() == 4 and second.select("content_hash").distinct().count() == 4
    assert "Spark lead" not in parsed[0] and "SQL dev" in parsed[0]
    out = {r["id"]: r for r in P.with_profiles(changed, second).collect()}
    assert out[1]["profile"]["terms"] == ["sql"] and out[1]["extras"] == {"salary": "9"}
    assert out[2]["profile"]["terms"] == ["spark", "sql"] and out[4]["profile"] is None and out[4]["extras"] == {"skills": "kept"}
    assert out[5]["profile"]["terms"] == [] and out[5]["extras"] == {"a": "b"}


def test_old_and_incomplete_profiles_are_stale(spark):
    jobs = spark.createDataFrame([(i, "feed", f"t{i}", "d", [], {}) for i in range(6)], JOB)
    full = [("sql",), {"sql": 1.0}, [("sql", "s")], 1.0, "hybrid", PROFILE_VERSION]
    bad = [full, [*full[:5], PROFILE_VERSION - 1], [(), *full[1:]], [full[0], {}, *full[2:]], [*full[:4], "pattern", PROFILE_VERSION]]
    hashes = {r["id"]: r["h"] for r in jobs.select("id", P.content_hash(F.col("title"), F.col("description"), F.col("tags")).alias("h")).collect()}
    table = spark.createDataFrame([(hashes[i], list(b[0]), *b[1:]) for i, b in enumerate(bad)], PROFILE)
    assert sorted(r["title"] for r in P.stale_texts(jobs, table).collect()) == ["t1", "t2", "t3", "t4", "t5"]
    twice = table.unionByName(table.filter(F.col("content_hash") == hashes[0]).withColumn("version", F.lit(1)))
    assert P.refresh_profiles(jobs, twice, lambda t: table.limit(0).drop("mode", "version")).count() == 6


def test_texts_are_hashed_and_searched_once(spark, builder):
    build, _ = builder
    plans = []

    def seen(texts):
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return build(texts)

    jobs = spark.createDataFrame([(1, "feed", "Spark lead", "Apache Spark is required.", ["x"], {}), (2, "feed", "Cook", "No such words.", None, {})], JOB)
    out = P.refresh_profiles(jobs, spark.createDataFrame([], PROFILE), seen)
    assert "sha2" not in plans[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "Generate" not in plan  # neither the hashes nor the search for terms are in the plan of the profiles
    assert sorted(len(r["terms"]) for r in out.collect()) == [0, 1]
