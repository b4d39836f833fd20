"""Quality rules, mixing and sharding against brute force, and their edge cases."""

import collections
import itertools
import zlib

import pytest

from pyspark.sql import functions as F

from docmarket.llm import mixing, quality_rules, sharding
from docmarket.llm.queries import SQL, QUERIES
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"
EDGES = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "a b c", None), (4, "w " * 3000, "y"), (4, "other", "y"), (5, "ä ß \t\n ü", "Z")]
SCHEMA = "doc_id bigint, text string, source string"


def frame(spark, rows):
    # Columns that operators use inside themselves, to see that they do not clash.
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("size", "unit", "shard", "key", "sid", "n", "id", "part", "target")})


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_mix_sources"])
def test_agrees_with_sql(spark, name):
    ok, message = compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], SQL[name])
    assert ok, message


def repeat_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})


def test_measures(spark):
    texts = ["a b c d e f a b c d e", "x " * 40, "one\none\n\n \none two", "", None, "#a *b $ % & | < >", "é ü z", "a b c d e\na b c d e q a b c d e"]
    rows = quality_rules.apply_rules(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    for row, text in zip(sorted(rows, key=lambda r: r["doc_id"]), texts):
        words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words)), text
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "") and row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == repeat_words(words), text
        assert row["base_failed"] == (len(words) < 10 or 100 * repeat_words(words) > 20 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_rule_order_is_by_rejections_per_cost(spark):
    docs = frame(spark, [(i, "word " * 12 + str(i), "s") for i in range(40)])
    rules = [quality_rules.Rule("never", F.lit(False), F.lit(1)), quality_rules.Rule("dear", F.col("n_words") > 0, F.lit(1000)), quality_rules.Rule("cheap", F.col("n_words") > 0, F.lit(10))]
    assert [r.name for r in quality_rules.order_rules(quality_rules.measure(docs), rules, "doc_id", 100)] == ["cheap", "never", "dear"]
    verdicts = {r["failed_rule"] for r in quality_rules.apply_rules(docs, rules).select("failed_rule").collect()}
    assert verdicts <= {"base", "cheap", "dear"}


def test_a_rejected_document_is_not_evaluated_again(spark):
    docs = frame(spark, [(i, " ".join(f"w{j}" for j in range(20)), "s") for i in range(5)])
    first = quality_rules.Rule("first", F.col("n_words") > 0, F.lit(1))
    boom = quality_rules.Rule("boom", F.raise_error(F.lit("evaluated")).cast("boolean"), F.lit(1000))
    measured = quality_rules.measure(docs).withColumn("base_failed", quality_rules.base_failed())
    out = measured.select(F.when(F.col("base_failed"), "base").when(first.fails, "first").when(boom.fails, "boom").alias("v"))
    assert {r["v"] for r in out.collect()} == {"first"}


def test_mix_edges(spark):
    rows = mixing.mix_sources(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_targets_end_where_none_is_above_its_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, "e": 0}
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(totals, (5, 2, 1), (3, 2), 2).collect()}
    weights = dict(zip("abcde", (5, 2, 1, 5, 2)))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not above:
            want |= {s: level * weights[s] for s in open_}
            break
        for s in above:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= above
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets_and_nested(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', if(id % 3 = 0, 0, id % 7)) AS source", "repeat('w ', int(1 + id % 9)) AS text")
    small = {r["doc_id"]: r for r in mixing.mix_sources(docs, share=(1, 2)).collect()}
    large = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert all(small[i]["copies"] <= large[i]["copies"] for i in small)
    for rows in (small, large):
        taken = collections.Counter()
        for i, r in rows.items():
            taken[0 if i % 3 == 0 else i % 7, r["target"]] += r["taken"]
        by_source = collections.Counter()
        for (source, _), v in taken.items():
            by_source[source] += v
        aims = {0 if i % 3 == 0 else i % 7: r["target"] for i, r in rows.items()}
        assert all(abs(by_source[s] - t) <= 9 for s, t in aims.items())


def best_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, fill = (low + high) // 2, 1, 0
        for x in sizes:
            n, fill = (n + 1, x) if fill + x > mid else (n, fill + x)
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("sizes", [[5], [3, 3, 3, 3], [100, 1, 1, 1, 1, 1, 1, 1], list(range(1, 60)), [7] * 39, [1, 50, 1, 50, 1, 50, 2, 2, 2], [1, 1, 1, 1, 1, 200, 1, 1]])
@pytest.mark.parametrize("k", [1, 2, 3, 5, 40])
def test_cuts_are_minimax(spark, sizes, k):
    units = spark.createDataFrame([(i * 3, s, 1) for i, s in enumerate(sizes)], "unit int, size bigint, n bigint")
    rows = sorted(sharding.cut_units(units, k).collect(), key=lambda r: r["unit"])
    shards = [r["shard"] for r in rows]
    assert len(rows) == len(sizes) and shards[0] == 0 and max(shards) < k and all(b - a in (0, 1) for a, b in zip(shards, shards[1:]))
    totals = [sum(sizes[i] for i in g) for _, g in itertools.groupby(range(len(sizes)), key=lambda i: shards[i])]
    assert max(totals) == best_capacity(sizes, k)


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sharding.shard_documents(docs, rows_per_part=3).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    homes, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 40
        homes[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_edges(spark):
    rows = sharding.shard_documents(frame(spark, EDGES), shards=3).collect()
    assert len(rows) == len(EDGES) and sorted(r["size"] for r in rows)[:2] == [16, 16]
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_rows_that_agree_in_everything_are_cut_into_pieces(spark):
    docs = frame(spark, [(None, "same text", "s")] * 2000 + [(i, f"text {i % 5}", "s") for i in range(300)])
    rows = sharding.shard_documents(docs.repartition(4), shards=3, rows_per_part=100).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 2300 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    units = spark.range(2000).select(F.lit(None).cast("long").alias("id"), F.lit(5).alias("size"), F.lit(7).alias("text_crc32"), F.lit(1).alias("unit"))
    placed = spark.createDataFrame([(1, 2000, 0, 20)], "unit int, n bigint, shard int, parts int")
    pieces = sharding.split_groups(units, placed, 100).groupBy("unit", "part", "piece").count().collect()
    assert sum(r["count"] for r in pieces) == 2000 and max(r["count"] for r in pieces) <= 300 and len(pieces) == 10


def test_rule_order_is_conditional_on_the_rules_before(spark):
    docs = frame(spark, [(i, " ".join(f"w{i}x{j}" for j in range(20 + i % 10)), "s") for i in range(200)])
    n = F.col("n_words")
    rules = [quality_rules.Rule("wide", n >= 24, F.lit(10)), quality_rules.Rule("covered", n >= 25, F.lit(11)), quality_rules.Rule("other", n == 20, F.lit(10))]
    # "covered" rejects more than "other", but nothing that "wide" has not rejected.
    assert [r.name for r in quality_rules.order_rules(quality_rules.measure(docs), rules, "doc_id", 1000)] == ["wide", "other", "covered"]


def test_the_sample_is_spread_over_hot_ids(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    some = quality_rules.sample_rows(docs, 1000)
    n, nulls = some.select(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    assert 1000 <= n <= 1400 and 0.4 < nulls / n < 0.6
    assert quality_rules.sample_rows(docs.limit(100), 1000).count() == 100


def test_columns_called_like_measures_are_replaced(spark):
    docs = frame(spark, EDGES)
    names = ("n_words", "kept", "base_failed", "failed_rule", "__words", "word_chars")
    key = lambda df: sorted(map(str, df.select("n_words", "kept", "base_failed", "failed_rule", "word_chars").collect()))
    assert key(quality_rules.apply_rules(docs.withColumns({c: F.lit("clash") for c in names}))) == key(quality_rules.apply_rules(docs))
