"""Edit-aware token counts against encoding the edited text anew."""

import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from docmarket.llm import token_counts as T
from docmarket.llm.queries import QUERIES

FOLDER, PATH = "/root/testdata/sf0.001", P.path("byte_bpe_50k.tiktoken")
TEXT = st.text(alphabet=st.sampled_from("ab Z'stl\n\t 12.!é漢　"), max_size=40)


def full(text):
    return len(T.pretokenizer(PATH, P.PATTERN).encoding.encode_ordinary(text))


@settings(max_examples=500, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 45), st.integers(0, 12), TEXT), max_size=5))
def test_any_edits(text, edits):
    tree = T.CountTree(text, T.pretokenizer(PATH, P.PATTERN))
    assert tree.tokens == full(text)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        text = text[:start] + new + text[start + size :]
        assert tree.text == text and tree.tokens == full(text) and int(tree.sums[1, 0]) == len(text)


def test_only_the_touched_region_is_read_again():
    tree = T.CountTree("some words of a text " * 5000, T.pretokenizer(PATH, P.PATTERN))
    assert 0 < tree.edit(50_000, 50_003, "new") < 60


def test_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, FOLDER).collect()}
    for doc in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        row, text = rows[doc["doc_id"]], doc["text"]
        size = len(text)
        assert row["n_tokens_before"] == full(text)
        for k in (3, 2, 1):
            at = size * k // 4
            text = text[:at] + f" [edit {doc['doc_id']}.{k}] " + text[at + 5 * k :]
        assert row["n_tokens"] == full(text)


def test_edges(spark):
    kind = "doc_id bigint, text string, edits array<struct<start:bigint,end:bigint,text:string>>"
    rows = [(1, None, None), (2, "", [(0, 9, "new text")]), (None, "abc", [None, (1, None, None), (99, 200, "!")]), (3, "x" * 50_000, [(7, 9, None)]), (3, "x" * 50_000, [])]
    docs = spark.createDataFrame(rows, kind).withColumns({c: F.lit("clash") for c in ("id", "n_tokens")})
    got = [tuple(r)[2:4] for r in T.count_edited(docs, PATH, P.PATTERN).collect()]
    assert got == [(0, 0), (0, full("new text")), (full("abc"), full("abc!")), (full("x" * 50_000), full("x" * 49_998)), (full("x" * 50_000),) * 2]
    assert T.count_edited(docs.limit(0), PATH, P.PATTERN).count() == 0
