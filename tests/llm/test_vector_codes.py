"""Lloyd over cover trees against plain Lloyd, and what the trees save."""

import math

import numpy as np
import pytest

from docmarket.llm.vector_codes import Work, assign, books_sha256, compress_vectors, grow, label_errors

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Rows (id, vector, label) in the order of the result's definition; codes, errors and books."""
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    data = np.array([v for _, v, _ in kept], object)
    bounds = [width * p // parts for p in range(parts + 1)]
    books, codes, errors = [], [], [0] * len(kept)
    for a, b in zip(bounds, bounds[1:]):
        points = [tuple(x) for x in data[:, a:b]]
        book = [list(x) for x in points[:entries]]
        nearest = lambda x: min(range(len(book)), key=lambda e: (sum((s - t) ** 2 for s, t in zip(x, book[e])), e))
        for _ in range(rounds):
            code = [nearest(x) for x in points]
            for e in set(code):
                own = [x for x, c in zip(points, code) if c == e]
                book[e] = [sum(col) // len(own) for col in zip(*own)]
        code = [nearest(x) for x in points]
        for i, (x, c) in enumerate(zip(points, code)):
            errors[i] += sum((s - t) ** 2 for s, t in zip(x, book[c]))
        books.append(book)
        codes.append(code)
    return sorted((str(i), str(l), [c[n] for c in codes], errors[n]) for n, (i, _, l) in enumerate(kept)), books


def result(spark, rows, **options):
    coded, books = compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted((str(r["vec_id"]), str(r["label"]), list(r["code"]), r["error"]) for r in coded.collect()), books


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_agrees_with_plain_lloyd(spark, entries):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8))
    rows = [(int(i), (centers[i % 12] + rng.normal(size=8) * 0.02).tolist(), int(i % 3)) for i in range(300)]
    got, books = result(spark, rows, entries=entries)
    want, plain_books = plain(rows, entries=entries)
    assert got == want and [b.tolist() for b in books] == plain_books


def test_nulls_ties_repeats_and_widths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, -0.5, 0.25, 2.0], None if i % 5 == 0 else i % 2) for i in range(30)] + [(3, [0.0, 1.0, -0.5, 0.25, 2.0], 1)] * 4
    rows += [(None, [5.0] * 5, 1), (None, [5.0] * 5, 1), (-1, None, 1), (-2, [nan] * 5, 1), (-3, [inf, 0.0, 0.0, 0.0, 0.0], 1), (-4, [None, 0.0, 0.0, 0.0, 0.0], 1), (90, [1.0, 2.0], 1)]
    got, books = result(spark, rows, parts=2, entries=9)
    want, plain_books = plain(rows, parts=2, entries=9)
    assert got == want and [b.tolist() for b in books] == plain_books
    coded, _ = compress_vectors(spark.createDataFrame(rows, SCHEMA), parts=2, entries=9)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    out = label_errors(coded).collect()
    assert len(out) == len(want) and all(r["label_error"] == sums[str(r["label"])] for r in out)


def test_empty_table_and_other_columns(spark):
    coded, books = compress_vectors(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books == [] and books_sha256(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert label_errors(coded).count() == 0
    other = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 2, "a", "b", "c")], "vec_id bigint, embedding array<double>, label int, code string, error string, LABEL string")
    assert compress_vectors(other)[0].first().asDict() == {"vec_id": 1, "label": 2, "code": [0, 0, 0, 0], "error": 0}
    none = spark.createDataFrame([(1, None, 2)], SCHEMA)
    assert compress_vectors(none)[0].count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [65535.0 - i % 4, -65535.5, 0.001 * i, 1.0], 0) for i in range(20)]
    got, books = result(spark, rows, entries=5)
    want, plain_books = plain(rows, entries=5)
    assert got == want and [b.tolist() for b in books] == plain_books


def test_tree_covers_and_saves_comparisons():
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, size=(30, 16))
    points = centers[rng.integers(0, 30, 1000)] + rng.integers(-9, 10, size=(1000, 16))
    points[200:400] = points[200]  # copies
    order, nodes = grow(points.astype(float))
    assert sorted(order.tolist()) == list(range(1000))
    place = np.argsort(order)
    for n in nodes:
        own = order[n["start"] : n["stop"]]
        assert n["center"] in own and np.sqrt(((points[own] - points[n["center"]]) ** 2).sum(1)).max() <= n["radius"] + 1e-6
        for child in nodes[n["child"] : n["child"] + n["children"]]:
            assert n["start"] <= child["start"] < child["stop"] <= n["loose"] and child["radius"] <= n["radius"] / 2 + 1e-6
    nodes["center"] = place[nodes["center"]]
    work = Work()
    code, sums, counts = assign(points[order], nodes, centers, work)
    distance = ((points[order][:, None] - centers[None]) ** 2).sum(2)
    assert (code == distance.argmin(1)).all() and work.whole > 900 and work.whole + work.compared == 1000
    assert (counts == np.bincount(code, minlength=30)).all() and (sums[code[0]] == points[order][code == code[0]].sum(0)).all()
