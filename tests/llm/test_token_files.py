"""Token files against the tokenizer itself, read back."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from docmarket.llm import token_files
from docmarket.llm.queries import QUERIES

FOLDER, PATH = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's we'll 'S", "<|endoftext|>a", "<|EndOfText|>.", "É́a é.", "a b c", "x.y.z...", "ΑΣ. İ! ſt", "a̸ ̸b", "don't.,", "12.5, 7!", "A.", "....", "word" * 300 + "."]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def check(plain, texts):
    ids, bounds = token_files.encoder(PATH).encode(pa.array(texts, pa.string()), 1)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [1], repr(t)


def test_odd_texts(plain):
    check(plain, ODD + [None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZéÀßœſŸªİŁ'.,!< |>\t\n\x0b́ Σß1٣#-‍漢s"), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    check(Tokenizer.from_file(PATH), texts)


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 3)
    for texts in (["a b c"], ["d e f g h a"], ["a x."]):
        check(plain, texts)


def test_files(spark, plain):
    rows = sorted(QUERIES["op6_token_files"](spark, FOLDER).collect(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    at = 0
    assert len(rows) == len(docs)
    for row, doc in zip(rows, docs):
        ids = plain.encode(doc["text"], add_special_tokens=False).ids + [1]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_edges_and_pruning(spark, tmp_path):
    rows = [(2, "b"), (1, None), (None, "x y"), (1, ""), (3, "c. " * 5000), (3, "c. " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("shard", "at", "ids")})
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, shards=3)
    got = sorted(token_files.token_report(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 3] and [r["n_tokens"] for r in got][1:4] == [1, 1, 2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    some = token_files.read_tokens(spark, str(tmp_path / "t"), [2, 99])
    assert [r["doc_id"] for r in some.collect()] == [2]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    token_files.write_tokens(docs.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.token_report(spark, str(tmp_path / "e")).count() == 0
