"""Exact search against brute force, and what the bounds leave out."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from docmarket.llm.inner_product import Queries, top_inner_products

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)


def brute(rows, queries, k):
    whole = lambda v: [math.floor(1024 * x) for x in v]
    candidates = [(i, whole(v)) for i, v in rows if usable(v)]
    out = set()
    for q, v in queries:
        v = whole(v)
        scores = sorted(((-sum(a * b for a, b in zip(v, c)), i is None, i or 0, i) for i, c in candidates if i != q and len(c) == len(v)), key=lambda x: x[:3])
        out |= {(q, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])}
    return out


def result(spark, rows, queries, k=10, **options):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, v, 0) for i, v in queries], SCHEMA)
    got = [tuple(r) for r in top_inner_products(vectors, asked, k, **options).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_agrees_with_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(700, 24)) * np.exp(rng.normal(size=(700, 1)) * spread)
    rows = [(int(i), v.tolist()) for i, v in enumerate(data)]
    queries = [r for r in rows if r[0] % 100 == 0]
    assert result(spark, rows, queries) == brute(rows, queries, 10)
    assert result(spark, rows, queries, 3, query_block=2) == brute(rows, queries, 3)


def test_nulls_ties_repeats_and_widths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, -1.0]) for i in range(1, 40)]  # ties
    rows += [(None, [1.0, 0.5, -1.0]), (None, [9.0, 9.0, -9.0]), (0, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, -1.0])]
    rows += [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 0.0, 0.0]), (53, [inf, 1.0, 1.0]), (54, [1e30, 1.0, 1.0])]
    rows += [(200, [1.0, 2.0]), (201, [3.0, 4.0]), (300, []), (301, []), (400, [0.0, 0.0, 0.0])]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    assert result(spark, rows, queries) == brute(rows, queries, 10)
    # Repeated rows are candidates each; an id that repeats among the queries asks once.
    vectors = spark.createDataFrame([(1, [1.0], 0), (1, [1.0], 0), (2, [2.0], 0), (100, [1.0], 0), (100, [1.0], 0)], SCHEMA)
    got = top_inner_products(vectors, vectors.filter(F.col("vec_id") == 100)).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1), (3, 1)]


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(100, [1.0, 2.0], 5, "x", "y")], "vec_id bigint, embedding array<double>, score int, numbers string, Vec_ID string")
    assert top_inner_products(empty, empty).count() == 0
    assert top_inner_products(some, empty).count() == 0
    assert top_inner_products(empty, some).count() == 0
    assert top_inner_products(some, some).count() == 0


def test_large_components_are_exact(spark):
    rows = [(100, [65535.9, 65535.9, 1.0]), (1, [65535.9, 65535.8, 0.001]), (2, [65535.9, 65535.8, 0.0]), (3, [-65535.9, 1.0, 1.0])]
    assert result(spark, rows, rows[:1]) == brute(rows, rows[:1], 10)


def test_bounds_leave_most_pairs_out():
    rng = np.random.default_rng(2)
    # Energy in few directions, and lengths that fall: both bounds have something to do.
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    data = np.round((rng.normal(size=(20_000, 64)) * 0.85 ** np.arange(64)) @ basis * 400 * np.exp(rng.normal(size=(20_000, 1)) * 0.5)).astype(np.int64)
    data = data[np.argsort(-(data**2).sum(1), kind="stable")]
    asked = data[::200]
    rotation = np.linalg.eigh((data.T @ data).astype(float))[1][:, ::-1]
    queries = Queries(np.arange(len(asked)) + 10**6, asked, rotation, np.full(len(asked), np.iinfo(np.int64).min), 10)
    for a in range(0, len(data), 2048):
        queries.take(np.arange(a, min(a + 2048, len(data))), data[a : a + 2048])
    scores = asked @ data.T
    order = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert (queries.found == order).all() and (queries.scores == np.take_along_axis(scores, order, 1)).all()
    assert queries.exact < 0.3 * len(asked) * len(data)
