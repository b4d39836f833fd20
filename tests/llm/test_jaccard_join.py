"""The Jaccard join against all pairs, on families of near copies, shared passages and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from docmarket.llm import jaccard_join as J


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((own, len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(links[i])))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 12, 20, 40, 150]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        if rng.random() < 0.3:
            words += passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("shingle,percent,group_tokens", [(3, 90, 400_000), (3, 90, 500), (5, 80, 2000), (1, 60, 3000)])
def test_all_pairs(spark, shingle, percent, group_tokens):
    rows = corpus(shingle + group_tokens, 240)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), shingle, percent, group_tokens)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, shingle, percent)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c d"), (7, "a b c d"), (7, "other text here"), (None, "a b c d"), (None, "lone text of null"), (8, long), (9, long + " end"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("id", "h", "node", "n", "group", "root")})
    got = J.jaccard_components(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 90)
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(0)
    for percent in (60, 80, 90):
        for n in [*range(1, 40), 100, 300, 1000]:
            for _ in range(10):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                drop = rng.integers(0, max(1, (100 - percent) * n // 100) + 1)
                b = np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, 2 + n // 10)).astype(np.uint64)))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                a, b = np.unique(a), np.unique(b)
                keys, row = J.block_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), percent)
                assert np.intersect1d(keys[row == 0], keys[row == 1]).size, (percent, n)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id * 7 % 61 AS a", "(id + 1) * 7 % 61 AS b").union(spark.createDataFrame([(100, 101)], "a bigint, b bigint"))
    assert {(r["node"], r["root"]) for r in J.connected(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_a_group_is_not_opened_without_overlap():
    far = [(1, 1, np.arange(10, dtype=np.uint64)), (2, 1, np.arange(5, 15, dtype=np.uint64))]
    links, edges = J.links_in_group(far, [(3, 1, np.arange(100, 110, dtype=np.uint64)), (4, 2, np.arange(10, dtype=np.uint64))], False, 90)
    assert links == {4: 1, 1: 2} and edges == [(4, 1)]


def test_copies_in_many_partitions_are_one_row(spark, monkeypatch):
    text = " ".join(f"c{i}" for i in range(50))
    rows = [(i, text) for i in range(40)] + [(i, text + f" e{i % 3}") for i in range(40, 60)]
    seen, group = [], J._in_groups

    def spy(sizes, entries, group_tokens):
        seen.append([[tuple(r) for r in df.collect()] for df in (sizes, entries)])
        return group(sizes, entries, group_tokens)

    monkeypatch.setattr(J, "_in_groups", spy)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), 3, 90, 60)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 90)
    ((sizes, entries),) = seen
    assert len(sizes) == 4 and len(entries) == len(set(entries))


@pytest.mark.parametrize("percent,n", [(80, 20), (80, 100), (80, 450), (90, 12), (60, 6)])
def test_unrelated_sets_share_no_block(percent, n):
    rng = np.random.default_rng(n)
    keys, row = J.block_keys(np.sort(rng.integers(0, 2**63, (500, n)).astype(np.uint64), axis=1).ravel(), np.arange(501) * n, percent)
    assert len(np.unique(row)) == 500 and len(np.unique(keys)) == len(keys)
