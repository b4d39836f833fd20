"""Costly expressions on texts are computed once per row and stay above the spread of a table's rows."""

from pyspark.sql import functions as F

from docmarket.functions import text as T
from docmarket.operators import structure as C, terms as E

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_clipped_text_is_normalised_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # the pattern names white space twice
    assert optimized(docs.select(T.clip(F.col("text"), 260))).count("x{205f}") == optimized(docs.select(T.normalize_ws(F.col("text")))).count("x{205f}")


def test_snippets_clean_a_sentence_once(spark):
    lexicon = spark.createDataFrame([("the", "article")], "surface string, term string")
    out = E.term_snippets(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["doc_id"], "text", lexicon)
    # the whole sentence, and the part of a long one
    assert optimized(out).count(r"\p{Ll}{1,4}") == 2


def test_texts_are_not_searched_in_the_scan(spark):
    docs = spark.createDataFrame([(1, "my skills", ["a", "b", "c"]), (2, "skills", ["a"]), (3, "unskilled", ["a"]), (4, "skills", [])], "doc_id int, text string, terms array<string>").repartition(3)
    sections = spark.createDataFrame([(2, "skills", "x")], "doc_id int, section string, text string")
    out = C.synthesize_section(sections, docs, "doc_id", "text", F.col("terms"), limit=2)
    assert not [line for line in optimized(out).splitlines() if "Filter" in line and "RLIKE" in line]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "skills", "a, b", True), (2, "skills", "x", False)]


def test_gaps_are_made_once_for_both_lists(spark):
    from docmarket.operators import gaps as L

    gaps = spark.createDataFrame([(1, "q", "a", 2, "live"), (1, "q", "a", 1, "weak-resume-proof"), (1, "q", "b", 3, "live")], "doc_id int, query_id string, term string, position int, signal_source string")
    missing, weak = L.split_missing_weak(gaps, spark.createDataFrame([(1, "b")], "doc_id int, term string"))
    assert "Window" not in optimized(missing) and "Window" not in optimized(weak)
    assert [(r["term"], r["signal_source"]) for r in missing.collect()] == [("a", "live")] and [(r["term"], r["signal_source"]) for r in weak.collect()] == [("b", "weak-resume-proof")]
