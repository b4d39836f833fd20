"""Block similarity and closest aliases against the standard library."""

import difflib
import random

import pytest

from pyspark.sql import functions as F

from docmarket.operators import taxonomy as R
from docmarket.operators.similarity import add_closest, block_ratio, matched_chars
from docmarket.roles import default_roles


def direct(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_of_all_label_pairs():
    names = sorted(default_roles().alias_map())
    left, right = zip(*[(a, b) for a in names for b in names])
    assert block_ratio(list(left), list(right)).tolist() == [direct(a, b) for a, b in zip(left, right)]


def test_ratio_of_odd_strings():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé🦉 ") for _ in range(rng.randint(0, n)))
    pairs = [("", ""), ("a", ""), ("", "a"), ("ab" * 200, "ba" * 150), ("abcabc", "abcxabc")]
    for _ in range(4000):
        a = word(20)
        pairs.append((a, word(20) if rng.random() < 0.5 else a[: rng.randint(0, 20)] + word(2) + a[rng.randint(0, 20) :]))
    left, right = map(list, zip(*pairs))
    assert block_ratio(left, right).tolist() == [direct(a, b) for a, b in pairs]
    assert matched_chars([], []).tolist() == []


@pytest.mark.parametrize("bar", [0.82, 0.6])
def test_closest_name(spark, bar):
    rng = random.Random(2)
    names = {n: f"role {i}" for i, n in enumerate(sorted(default_roles().alias_map()))}
    labels = [None, "", "x", *list(names)[:40]]
    for n in names:
        i = rng.randrange(len(n))
        labels += [n[:i] + "x" + n[i:], n[:i] + n[i + 1 :], n[1:] + n[0], n + " lead", n.replace(" ", "")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    out = {r["i"]: r["c"] for r in add_closest(df, "c", F.col("label"), names, lambda c: F.lit(bar)).collect()}
    for i, label in enumerate(labels):
        best = max(((direct(n, label), n) for n in names), default=None) if label else None
        want = best if best and best[0] >= bar else None
        got = out[i] and (out[i]["ratio"], out[i]["name"])
        assert got == want and (want is None or out[i]["value"] == names[want[1]]), label
    assert all(r["c"] is None for r in add_closest(df, "c", F.col("label"), names, lambda c: F.lit(bar), F.lit(False)).collect())


def test_glued_label_finds_its_role(spark):
    lex = default_roles()
    alias = max(lex.alias_map(), key=len)
    glued = alias.replace(" ", "")[:-1] + "q"  # one letter off, and no blanks
    row = R.fuzzy_alias(spark.createDataFrame([(glued,)], "cleaned string"), lex).first()
    assert row["close"]["role"] == lex.alias_map()[alias]
