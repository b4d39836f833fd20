"""Rows on which a query and its SQL once differed: bare character references, letters outside ASCII, equal lines, halves."""

import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from docmarket.operators import requirements as RQ
from tools.check import compare

BASE = "/root/testdata/sf0.001"
TEXTS = (
    "a&amp b &ampc &&&amp &lt;p&gt;x &notit; &notin; &#233; &#x80;&#0; &#xD800; &#1114112; &#11;|", "5 à la carte, 3ñ 7 x, 40% 2k 4 K 9 days  8 weeks 6 hourſ 12 é", "&", "", "٣ x 5٣% 7²x 3—x 4·k",
)


def folder(path, **selects):
    """The tables of the smallest data folder, some of them replaced by a select over it."""
    con = duckdb.connect()
    for name in "part orders lineitem customer pages documents conversations".split():
        select = selects.get(name, "SELECT * FROM t")
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM read_parquet('{BASE}/{name}.parquet')")
        con.execute(f"COPY ({select}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def literal(texts):
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def agree(spark, con, path, *names):
    for name in names:
        ok, message = compare(spark, con, str(path), name, queries()[name], oracle_sql()[name])
        assert ok, f"{name} {message}"


def test_bare_references_in_html(spark, tmp_path):
    texts = literal(TEXTS)
    pick = lambda column, key: f"SELECT * REPLACE (({texts})[{key} % {len(TEXTS)} + 1] AS {column}) FROM t"
    con = folder(tmp_path, pages=pick("html", "page_id"), documents=pick("text", "doc_id"), conversations=pick("text", "conv_id"))
    agree(spark, con, tmp_path, "B1_strip_html", "A1_unify_listings", "A4_prepare_listing_text")


def test_letters_outside_ascii_are_no_units(spark, tmp_path):
    con = folder(tmp_path, documents=f"SELECT * REPLACE (({literal(TEXTS)})[doc_id % {len(TEXTS)} + 1] AS text) FROM t")
    agree(spark, con, tmp_path, "M9_text_evidence")


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_equal_lines_of_an_order(spark, tmp_path, order):
    twice = f"SELECT * FROM (SELECT * FROM t UNION ALL SELECT * REPLACE (51 - l_quantity AS l_quantity) FROM t) ORDER BY l_quantity {order}, l_orderkey"
    con = folder(tmp_path, lineitem=twice)
    agree(spark, con, tmp_path, "N1_recommendations", "N3_rule_summary")


def test_quality_of_a_profile_is_rounded_from_exact_sums(spark):
    rng = random.Random(4)
    weights = {i: [rng.randrange(36, 101) for _ in range(rng.randrange(1, 9))] for i in range(4000)}
    profile = spark.createDataFrame([(i, f"t{n}", w / 100) for i, ws in weights.items() for n, w in enumerate(ws)], "listing_id int, term string, weight double")
    got = {r["listing_id"]: r["quality"] for r in RQ.assemble_profile(profile, "listing_id").select("listing_id", "quality").collect()}
    for i, ws in weights.items():
        top = sorted(ws, reverse=True)[:6]
        assert got[i] == float((Decimal(sum(top)) / len(top)).quantize(Decimal("0.1"), ROUND_HALF_UP)), ws
