import random

from pyspark.sql import functions as F

from docmarket.operators import dedupe as D, ranking, select as J
from docmarket.sources import listings as L


def greedy(rows, target, floor, waves, limit):
    """Plain sequential selection, the meaning of select_diverse."""
    kept = []
    for no, wave in enumerate(waves):
        if len(kept) >= (target if wave.until == "live_target" else floor):
            continue
        for r in sorted((r for r in rows if r[wave.flag]), key=lambda r: r["rank"]):
            n, low = len(kept), len(kept) < floor
            if n >= limit:
                break
            if any(k["key"] == r["key"] for k in kept) or sum(k["company"] == r["company"] for k in kept) >= wave.company_cap:
                continue
            if sum((k["company"], k["title_key"]) == (r["company"], r["title_key"]) for k in kept) >= (r["title_cap_low"] if low else r["title_cap"]):
                continue
            similar = r["similar_ok_low"] if low else (r["similar_ok"] and n < target)
            if not similar and any(k["signature"] == r["signature"] for k in kept):
                continue
            if not wave.ignore_source_cap and not low and sum(k["source"] == r["source"] for k in kept) >= r["source_cap"]:
                continue
            kept.append(r)
    return [r["key"] for r in kept]


def test_select_diverse_equals_sequential_scan(spark):
    rng = random.Random(7)
    waves = (J.Wave("a", 2), J.Wave("b", 3, ignore_source_cap=True), J.Wave("z", 5, until="display_floor"))
    rows = []
    for q in range(6):
        for i in range(rng.choice([5, 60, 150])):
            strong = rng.random() < 0.4
            rows.append(
                dict(
                    query_id=q, rank=i + 1, key=q * 1000 + i, source=rng.choice("xyx"), company=rng.choice("ABCD") if q % 2 else "A" + str(rng.randint(0, 30)), title_key=rng.choice("tuv"), signature=str(rng.randint(0, 9)),
                    source_cap=rng.choice([2, 4]), title_cap_low=rng.choice([1, 3]), title_cap=1, similar_ok_low=strong, similar_ok=strong, a=rng.random() < 0.5, b=rng.random() < 0.7, z=rng.random() < 0.3,
                )
            )
    df = spark.createDataFrame(rows)
    queries = spark.createDataFrame([(q, 9, 5) for q in range(6)], "query_id long, live_target int, display_floor int")
    got = {}
    for r in J.select_diverse(df, queries, waves, 12).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    for q in range(6):
        assert got.get(q, []) == greedy([r for r in rows if r["query_id"] == q], 9, 5, waves, 12), q


def test_group_size_with_hot_group(spark):
    df = spark.range(0, 1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 998, F.col("id").cast("string")).alias("k"))
    got = ranking.with_group_size(df, ["k"], "n")
    assert got.count() == 1000
    assert {(r["k"] == "hot", r["n"]) for r in got.collect()} == {(True, 700), (False, 1), (False, 2)}


def test_all_candidates_are_ranked(spark):
    rows = spark.range(5000).select(F.lit(1).alias("query_id"), F.col("id").alias("key"), *[(F.col("id") % 7).alias(k.lstrip("-")) for k in J.RANK_KEYS])
    assert [r["rank"] for r in J.rank_candidates(rows, "key").orderBy("rank").collect()] == list(range(1, 5001))


def test_floor_above_fifteen_is_filled(spark):
    selected = spark.createDataFrame([(1, 100)], "query_id int, key int")
    safe = spark.range(30).select(F.lit(1).alias("query_id"), F.col("id").cast("int").alias("key"))
    floors = spark.createDataFrame([(1, 20)], "query_id int, floor int")
    assert J.fill_to_floor(selected, safe, floors, "key").count() == 20


def test_near_duplicates_keep_exempt_rows(spark):
    df = spark.createDataFrame([(1, "s", False), (2, "s", False), (3, "s", True), (4, "t", None)], "arrival int, sig string, ex boolean")
    assert sorted(r["arrival"] for r in D.near_duplicates(df, "sig", "arrival", F.col("ex")).collect()) == [1, 3, 4]


def test_compare_runs_ties_and_case(spark):
    rows = [("r1", "u", "Data  Analyst", "2024-01-01", 10.0), ("r2", "u", "data analyst", "2024-01-01", 12.0), ("r3", "u", "DATA analyst", "2024-02-09", 11.5), ("r4", "u", "other", "2024-01-05", 1.0)]
    df = spark.createDataFrame(rows, "run_id string, user_id string, role_query string, created_at string, overall_score double").withColumn("created_at", F.col("created_at").cast("timestamp"))
    df = df.withColumns({c: F.col("overall_score") for c in D.COMPONENTS})
    got = {r["run_id"]: (r["previous_run_id"], r["score_delta"], r["direction"]) for r in D.compare_runs(df).collect()}
    assert got == {"r1": ("r2", -2.0, "decreased"), "r2": ("r1", 2.0, "increased"), "r3": ("r2", -0.5, "decreased"), "r4": (None, 1.0, "baseline")}


def test_upsert_is_idempotent_and_keeps_created_at(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    target = spark.createDataFrame([("s", "1", "old", "2024-01-01")], "source string, external_id string, title string, d string")
    target = target.select("source", "external_id", "title", *[F.col("d").cast("timestamp").alias(n) for n in ("last_seen_at", "created_at", "cached_until")])
    batch = spark.createDataFrame([("s", "1", "new", 1), ("s", "1", "newer", 2), ("s", "2", "x", 3)], "source string, external_id string, title string, arrival int")
    once = L.upsert_listings(target, batch, now, ["source", "external_id"])
    twice = L.upsert_listings(once, batch, now, ["source", "external_id"])
    key = lambda df: sorted((r["external_id"], r["title"], str(r["created_at"])[:10]) for r in df.collect())
    assert key(once) == key(twice) == [("1", "new", "2024-01-01"), ("2", "x", "2024-01-02")]


def test_expiry_at_now_is_expired(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "d string").withColumn("cached_until", F.col("d").cast("timestamp"))
    assert df.filter(L.is_live(F.lit("2024-01-01").cast("timestamp"))).count() == 2


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(3, 8)]) for _ in range(n))
    left = [(i, text(6)) for i in range(40)]
    right = [(i, text(4)) for i in range(25)]
    got = {(r["l"], r["r"]) for r in D.overlap_join(spark.createDataFrame(left, "l int, t string"), spark.createDataFrame(right, "r int, t string"), "l", "r", "t", 0.6, 100).collect()}
    want = {(a, b) for a, s in left for b, u in right if len(set(s.split()) & set(u.split())) / len(set(u.split())) >= 0.6 - 1e-9}
    assert got == want


def test_lookup_takes_any_limit_and_cuts_before_the_join(spark):
    live = spark.range(400).selectExpr("id AS external_id", "'r' AS normalized_role", "'l' AS location_query", "timestamp_seconds(id % 200) AS last_seen_at", "CAST(NULL AS TIMESTAMP) AS cached_until")
    asked = spark.sql("SELECT * FROM VALUES (1, 'r', 'l', 300), (2, 'r', 'l', 3), (3, 'r', 'l', CAST(NULL AS INT)) AS t(query_id, normalized_role, location_query, limit)")
    out = L.lookup_live(live, asked, F.lit("2024-01-01").cast("timestamp"))
    assert {r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 300, 2: 3}
    assert [r["external_id"] for r in out.filter("query_id = 2").orderBy("rank").collect()] == [199, 399, 198]
    assert L.lookup_live(live, asked.limit(0), F.current_timestamp()).count() == 0


def test_a_surface_of_six_words_is_found(spark):
    from docmarket.operators.terms import match_terms

    lexicon = spark.sql("SELECT * FROM VALUES ('very deep neural network model training', 'long'), ('neural network', 'short') AS t(surface, term)")
    text = spark.sql("SELECT 1 AS id, 'We do very deep neural network model training daily' AS text")
    assert sorted(tuple(r) for r in match_terms(text, ["id"], "text", lexicon).collect()) == [(1, "long", 1, 2), (1, "short", 1, 4)]
    assert match_terms(text, ["id"], "text", lexicon.limit(0)).count() == 0


def test_overlap_join_is_exact_for_any_prefix(spark):
    rng = random.Random(4)
    words = [f"tok{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 15)))
    left, right = [(i, text()) for i in range(120)], [(i, text()) for i in range(120)] + [(200, words[0]), (201, "")]
    lf, rf = spark.createDataFrame(left, "l int, t string"), spark.createDataFrame(right, "r int, t string")
    sets = lambda rows: {i: set(t.split()) for i, t in rows}
    for share in (0.3, 0.5, 1.0):
        want = set()
        for i, a in sets(left).items():
            near = sorted((-len(a & b) / len(b), j, len(a & b)) for j, b in sets(right).items() if b and len(a & b) >= share * len(b) - 1e-9)
            want |= {(i, j, c, k + 1) for k, (_, j, c) in enumerate(near[:3])}
        for agree in (1, 3):
            got = {(r["l"], r["r"], r["shared"], r["rank"]) for r in D.overlap_join(lf, rf, "l", "r", "t", share, 3, agree).collect()}
            assert got == want, (share, agree)


def test_wide_projections_are_split_into_small_methods(spark):
    from docmarket.session import METHOD_LIMIT, small_methods

    from __spark_entry__ import queries

    before = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.set(METHOD_LIMIT, "65535")
        queries()["J2_select_diverse"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(METHOD_LIMIT) == "8000"  # HotSpot compiles no larger ones
        spark.conf.set(METHOD_LIMIT, "20000")
        small_methods(spark)
        assert spark.conf.get(METHOD_LIMIT) == "20000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)
