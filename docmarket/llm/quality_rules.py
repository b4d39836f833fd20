"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` is true. ``reads`` is what one evaluation walks over, as columns, times ``weight``."""

    name: str
    fails: Column
    reads: Column
    weight: float = 1.0


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), SPLIT), "")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add __words and the base measures of every whole text, computed inside its row.

    Five-word windows are compared by 64-bit hashes of their words; a text without two equal hashes,
    the usual case, stops there. Only other texts sort their windows to mark the repeated ones.
    """
    words = F.coalesce(words_of(text), F.array().cast("array<string>"))
    out = docs.withColumn("__words", words).withColumn("n_words", F.size("__words").cast("long"))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("__lines", lines).withColumn("__joined", F.concat_ws("", "__words"))
    out = out.withColumns({
        "word_chars": F.length("__joined").cast("long"), "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__n_lines": F.size("__lines").cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    out = out.withColumn("__windows", F.expr(f"CASE WHEN n_words < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, CAST(n_words AS int) - {WINDOW}), i -> xxhash64({', '.join(f'get(__hashes, i + {k})' for k in range(WINDOW))})) END"))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    # Neighbours of one hash give both places; a place stands for its five words, and overlaps count once.
    places = F.expr("array_sort(array_distinct(flatten(zip_with(slice(__sorted, 1, size(__sorted) - 1), slice(__sorted, 2, size(__sorted) - 1), (a, b) -> IF(a.w = b.w, array(a.i, b.i), CAST(array() AS array<int>))))))")
    out = out.withColumn("__places", F.when(F.col("__sorted").isNotNull(), places))
    covered = F.expr(f"aggregate(__places, named_struct('end', 0, 'n', 0), (s, p) -> named_struct('end', p + {WINDOW}, 'n', s.n + p + {WINDOW} - greatest(p, s.end)), s -> CAST(s.n AS bigint))")
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return out.drop("__hashes", "__windows", "__sorted", "__places", "__lines")


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the columns of ``measure``; shares are taken of words, lines or letters."""
    share = lambda part, whole, percent: 100 * part > percent * whole
    words, n = F.col("__words"), F.col("n_words")
    upper = F.length(F.regexp_replace("__joined", "[^A-Z]", ""))
    lower = F.length(F.regexp_replace("__joined", "[^a-z]", ""))
    echoes = F.size(F.expr("filter(zip_with(slice(__words, 1, size(__words) - 1), slice(__words, 2, size(__words)), (a, b) -> a = b), x -> x)"))
    return [
        Rule("symbols", share(F.col("n_symbols"), n, 20), F.lit(1)),
        Rule("duplicate_lines", share(F.col("n_dup_lines"), F.col("__n_lines"), 50), F.lit(1)),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), F.lit(1)),
        Rule("upper_case", upper > lower, F.col("word_chars"), 2.0),
        Rule("exclamations", share(F.regexp_count("__joined", F.lit("!")), n, 50), F.col("word_chars"), 1.0),
        Rule("few_distinct_words", (n >= 50) & (10 * F.size(F.array_distinct(words)) < n), n, 6.0),
        Rule("echoed_words", (n > 1) & share(echoes, n, 30), n, 3.0),
    ]


def order_rules(measured: DataFrame, rules: Sequence[Rule], id: str, sample: int) -> list[Rule]:
    """Rules by rejections per cost, best first, from at most ``sample`` rows of the smallest id hashes.

    Every rule is evaluated on all sampled rows; its cost is the mean of what it reads times its weight.
    The next rule is the one that rejects most per cost among the rows that pass the base and all rules before it
    (among all rows if none passes the base). Ties keep the given order. Only verdicts and costs leave the
    rows, never texts; the driver gets one row per combination of verdicts, at most ``sample``.
    """
    fails = [F.coalesce(r.fails, F.lit(False)).alias(f"f{i}") for i, r in enumerate(rules)]
    costs = [(r.reads * r.weight).cast("double").alias(f"c{i}") for i, r in enumerate(rules)]
    slim = measured.select(F.xxhash64(id).alias("hash"), base_failed().alias("base"), *fails, *costs).orderBy("hash").limit(sample)
    verdicts = [f"f{i}" for i in range(len(rules))]
    seen = slim.groupBy("base", *verdicts).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))]).collect()
    rows = [r for r in seen if not r["base"]] or seen
    total = sum(r["n"] for r in rows)
    cost = [max(sum(r[f"c{i}"] or 0.0 for r in rows) / max(total, 1), 1.0) for i in range(len(rules))]
    ordered, left = [], list(range(len(rules)))
    while left:
        best = max(left, key=lambda i: ((sum(r["n"] for r in rows if r[f"f{i}"]) + 0.5) / cost[i], -i))
        ordered.append(rules[best])
        left.remove(best)
        rows = [r for r in rows if not r[f"f{best}"]]
    return ordered


def sample_rows(docs: DataFrame, sample: int, seed: int = 17) -> DataFrame:
    """About 1.2 times ``sample`` rows, spread over all of ``docs``: every row is drawn for itself, so no hot key comes whole."""
    total = docs.count()
    return docs if total <= sample else docs.sample(fraction=1.2 * sample / total, seed=seed)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, sample: int = 1000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the base measures, base_failed, failed_rule (null where none) and kept to every row.

    Once a rule has rejected a document the later ones are not evaluated for it: they are branches of
    one CASE, and a document that fails the base has no branch at all.

    Nulls: a null text has no words and fails the base, like an empty one; a null id changes nothing.
    Repeated rows are judged each. An empty table gives no rows. Long texts are measured whole, inside their row.
    Other columns are kept; one called like a measure or verdict is replaced by it.

    The sample decides how much work is done, and which of several failing rules is named, never what is kept.
    """
    rules = list(default_rules() if rules is None else rules)
    few = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    ordered = order_rules(measure(sample_rows(few, sample)), rules, "id", sample)
    out = measure(docs, text).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    out = out.withColumn("failed_rule", verdict)
    return out.withColumn("kept", F.col("failed_rule").isNull()).drop("__words", "__joined", "__n_lines")
