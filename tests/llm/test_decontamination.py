"""Benchmark windows against brute force, with one block and with many."""

import random
import re

import pytest

from docmarket.llm.decontamination import find_leaks, hit_words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text, items, window=10):
    words = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            part = w[k : k + window]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(name or "")
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_agrees_with_brute_force(spark, block_bytes):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "\u00e9", "d-e"]) for _ in range(n))
    items = [("x", text(14)), ("y", text(12)), ("y", text(30)), (None, text(11)), ("short", "zz b"), ("empty", ""), ("null", None), ("w", text(10))]
    docs = [(i, text(rng.randint(0, 25)) + " " + (rng.choice(items)[1] or "") + " " + text(5)) for i in range(60)]
    docs += [(60, None), (61, ""), (61, "ZZ, B!"), (None, items[0][1]), (62, "zz"), (63, (text(2000) + " " + items[3][1] + " ") * 20)] + [(64, items[1][1])] * 2
    frame = spark.createDataFrame([(i, t, 5, "own", "own", "kept") for i, t in docs], "doc_id int, text string, n_words int, spans string, items string, other string")
    out = find_leaks(frame, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes)
    got = [(r["doc_id"], r["n_words"], r["hit"], list(r["items"]), r["other"]) for r in out.withColumn("hit", hit_words()).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted([(i, *brute(t, items), "kept") for i, t in docs], key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    items = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert find_leaks(docs.limit(0), items).count() == 0
    assert list(find_leaks(docs, items.limit(0)).first()["items"]) == []
