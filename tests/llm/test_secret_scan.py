"""Secret scans against plain regular expressions and entropy from scratch."""

import math
import random
import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from docmarket.llm import secret_scan as S
from docmarket.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PLAIN = {
    "assign": (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16),
}


def plain(text):
    out = [(m.start(), list(PLAIN).index(k), k, m.end()) for k, (p, g, n) in PLAIN.items() for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def windows(text, rule):
    out = []
    for i in range(len(text) - rule.window + 1):
        part = text[i : i + rule.window]
        bits = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
        kinds = [any(c.islower() for c in part), any(c.isupper() for c in part), any(c.isdigit() for c in part)]
        hexes = set(part) <= set("0123456789abcdef") and kinds[0] and kinds[2]
        if bits >= (rule.hex_bits if hexes else rule.mixed_bits if sum(kinds) >= 2 else 99) - 1e-9:
            if out and i <= out[-1][1]:
                out[-1][1] = i + rule.window
            else:
                out.append([i, i + rule.window])
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdef0123456789", max_size=40) | st.text(alphabet="abXYZ0189+/_=-qwertyuiopASDF", max_size=60))
def test_windows(text):
    rule = S.Entropy(window=12, hex_bits=2.8, mixed_bits=3.2)
    assert S.suspect_windows(text, rule) == windows(text, rule)


def test_base_spans_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op7_secret_scan"](spark, FOLDER).collect():
        want = plain(texts[r["doc_id"]])
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("entropy")] == [f"{k}:{a}:{b}" for k, a, b in want]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for x, _, _ in want) for k in PLAIN)


def test_edges(spark):
    rng = random.Random(1)
    key = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32))
    texts = [
        None, "", f"é key {key} end", "TOKEN = 'abcdefghijkl'", "ſecret=abcdefghijklmn", "tokenſ: abcdefghijklmn", "password: short", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "0" * 15, "é" + "a1" * 8,
        "123e4567-e89b-12d3-a456-426614174000", f"example{key}", "a" * 200_000 + " secret=" + "x" * 12, "Verheitzustschkeiten" * 3, key + "\n" + key, "api_key:\"k=k/k-k_k.kkk\"",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("kind", "start", "end")})
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in S.scan_secrets(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "entropy"] == plain(t), t
    assert got[2] == [("entropy", 6, 38)] and got[12] == [] and got[11] == [] and got[14] == []
    assert got[15] == [("entropy", 0, 32), ("entropy", 33, 65)]
    assert {tuple(s) for s in S.scan_secrets(docs.filter("doc_id = 2"), allowed=[key]).first()["secrets"]} == set()
    assert S.scan_secrets(docs.limit(0)).count() == 0


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = {"upper hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "upper base36": DIGITS + UPPER, "base36": DIGITS + LOWER, "base62": DIGITS + LOWER + UPPER, "base64": DIGITS + LOWER + UPPER + "+/"}


def test_recall_by_class_and_length():
    rng, never = random.Random(3), re.compile(r"(?!)")
    for name, alphabet in CLASSES.items():
        for length in (20, 24, 32, 40, 64):
            keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(400)]
            whole = sum((3, 2, 2 + length) in S.scan_text(f"a {k} b", S.BY_CLASS, never) for k in keys)
            assert whole >= 0.96 * len(keys), (name, length, whole)


def test_fixed_patterns_are_cut_out_of_a_secret():
    never = re.compile(r"(?!)")
    left, right, hexes = "Kx7QmZ2vLp9RtY4w", "Jn5BsGh8UdVc3TfE", "0f1e2d3c4b5a69788796"
    assert S.scan_text(left + hexes + right, S.BY_CLASS, never) == [(3, 0, 16), (2, 16, 36), (3, 36, 52)]
    assert S.scan_text("user-" + hexes, S.BY_CLASS, never) == [(2, 5, 25)]
    assert S.scan_text("The quick brownfoxjumpsoverthelazydog Verwaltungsgerichtsbarkeit state-of-the-art-Solutions", S.BY_CLASS, never) == []


def test_allow_list_takes_parts_of_strings(spark):
    key = "Xk29dLqPz81mNvB7tQw4Ra"
    texts = [
        f"/srv/files/{key}", f"/srv/sample/{key}", f"/srv/samples-1/{key}", "/srv/sample/", f"Xk29dLqP0123456789{key}", "0123456789abcdefghijklmnopqrstuvwxyz",
        f"123e4567-e89b-12d3-a456-426614174000/{key}", "123e4567-e89b-12d3-a456-426614174000", f"my{key}EXAMPLEKEY", f"{key}/{key[::-1]}EXAMPLEKEY",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("secrets", F.lit("clash"))
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["secrets"] if s["kind"] == "entropy"] for r in S.scan_secrets(docs).collect()}
    assert got[0] == [texts[0]] and got[1] == ["/" + key] and got[2] == ["/" + key] and got[6] == ["/" + key]
    assert got[4][-1] == key and not any(got[i] for i in (3, 5, 7, 8, 9))
