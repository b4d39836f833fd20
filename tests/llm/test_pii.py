"""Personal data against plain regular expressions, and the label model on known reliabilities."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from docmarket.llm import pii as P
from docmarket.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-0é ", max_size=25) | st.text(alphabet="0125.", max_size=30) | st.text(alphabet="+0123 ().-", max_size=40))
def test_base_spans(text):
    assert P.base_spans(text) == plain(text)


def test_luhn():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")


def test_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        named = ",".join(f"{P.BASE[k]}:{a}:{b}" for k, a, b in want)
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(i == x for x, _, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest() and r["spans"].startswith(named)
        for s in r["spans"][len(named) :].strip(",").split(","):
            assert not s or s.startswith("likely_")


def test_reliabilities_are_found():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    votes = np.where(rng.random((20000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((20000, 6)) < 0.2] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = P.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(found - right).max() < 0.03
    # As good as the best rule that knows prior and reliabilities.
    best = np.log(0.3 / 0.7) + votes @ np.log(right / (1 - right)) > 0
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > (best == truth).mean() - 0.005


def test_classifier_on_held_out_patterns():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**P.FEATURES, 4000)
    truth = ((bits & 1) + (bits >> 3 & 1) - (bits >> 5 & 1)) >= 1
    w = P.train_classifier(bits[:3000], truth[:3000].astype(float), np.ones(3000))
    x = np.column_stack((np.ones(1000), (bits[3000:, None] >> np.arange(P.FEATURES)) & 1))
    assert ((x @ w > 0) == truth[3000:]).mean() > 0.97


def test_edges(spark):
    texts = [None, "", "no data here", "a@b.c@d.e", "call (555) 123-4567 now", "é x.y@z.org é", "9" * 6000, "1.2.3.4.5.6.7.8", "write to jane [at] mail [dot] org", "0" * 100_000 + " +1 (017) 555-7713", "+" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("base", "candidates", "kind", "start")})
    rows = P.find_personal_data(docs).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == [(P.BASE[k], a, b) for k, a, b in P.base_spans(texts[r["doc_id"]] or "")]
        assert all(s["kind"] in P.LIKELY for s in r["added"])
    assert P.find_personal_data(docs.limit(0)).count() == 0


def test_columns_called_like_the_spans_give_way(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or call +49 30 1234567"), (2, None)], "doc_id bigint, text string")
    rows = lambda df: sorted(str((r["doc_id"], r["base"], r["added"])) for r in P.find_personal_data(df).collect())
    assert rows(docs.withColumns({c: F.lit("clash") for c in ("base", "added", "candidates")})) == rows(docs)
