"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docmarket.llm.fim import SENTINELS, ExceptionIndex, check_sentinels, fill_in_middle, restored

SCHEMA = "doc_id bigint, text string, `output` string, form string, Text string, n string"


def plain(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    pieces = ["a", "\n", "é", "語", "🦉", "\r", " ", "<", "<S", "P>", "́", "M", " "]
    out = [None, "", "\n", "\n\n\n", "no line feed", "<P>", "x\n<M>\ny", "<", "🦉" * 50, "é\n" * 40, "plain ascii\n" * 3000]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["語 word\n" * 400_000]


@pytest.mark.parametrize("unit, rate, spm_rate", [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("char", 70, 100)])
def test_agrees_with_plain_version(spark, unit, rate, spm_rate):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())] + [(7, "again\nand\nagain")] * 3
    docs = spark.createDataFrame([(i, t, "own", "own", "own", "own") for i, t in rows], SCHEMA)
    out = fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm_rate)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(out["output"], out["form"])).collect()]
    want = [(i, *plain(i, t, unit, rate, spm_rate), t or "") for i, t in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {"plain"} < {r[2] for r in got}


def test_exceptions_convert_both_ways():
    text = "ab" + "é" * 3 + "語z🦉" + "q" * 10 + "é"
    raw = np.frombuffer(text.encode(), np.uint8)
    index = ExceptionIndex(raw)
    chars = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in chars])
    assert index.to_bytes(chars).tolist() == at.tolist() and index.to_chars(at).tolist() == chars.tolist()
    assert len(index.bytes_at) == 6  # only the multibyte characters are kept
    assert len(ExceptionIndex(np.frombuffer(b"ascii only" * 100, np.uint8)).bytes_at) == 0


def test_kept_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y", "z", "w")], SCHEMA)
    row = fill_in_middle(docs, keep=("Text", "n", "output")).first()
    assert row["kept"].asDict() == {"Text": "z", "n": "w", "output": "x"} and row["n"] == 2
    assert fill_in_middle(docs.limit(0)).count() == 0
    twice = docs.toDF("doc_id", "text", "a", "a", "TEXT", "DOC_ID")
    assert fill_in_middle(twice).count() == 1
    with pytest.raises(ValueError):
        fill_in_middle(docs, text="missing")


def test_ambiguous_sentinels_are_refused():
    check_sentinels(SENTINELS)
    for bad in [("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("aba", "x", "y"), ("abc", "b", "d"), ("", "x", "y")]:
        with pytest.raises(ValueError):
            check_sentinels(bad)


def test_other_sentinels_round_trip(spark):
    marks = ("[pre.]", "[suf$]", "{mid+}")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a\nb\nc\n", "x [pre.] y\nz", "[pre\n.]\n[suf"])], "doc_id bigint, text string")
    out = fill_in_middle(docs, sentinels=marks)
    rows = {r["doc_id"]: r for r in out.select("doc_id", "form", restored(out["output"], out["form"], marks).alias("t")).collect()}
    assert [rows[i]["t"] for i in range(3)] == ["a\nb\nc\n", "x [pre.] y\nz", "[pre\n.]\n[suf"] and rows[1]["form"] == "plain" and rows[0]["form"] != "plain"
