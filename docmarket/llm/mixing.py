"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket.session import cut_lineage

STEP = 12  # bits of the hash that one histogram resolves
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Add sid, weight and target to (source, source_size).

    Sources in code-point order, null last, take the weights in turn. They share
    ``share[0] / share[1]`` of all sizes by weight; none gets more than ``most`` times its size, and
    what is above is shared again. That ends where a source gets min(most * size, level * weight):
    sources that reach their limit first are a prefix in the order of limit / weight.
    One row per source; the windows without a key run over these rows only.
    """
    listed = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("sid") % len(weights))
    out = totals.withColumn("sid", (F.row_number().over(listed) - 1).cast("int")).withColumn("weight", weight)
    out = out.withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0))
    level = (F.sum("source_size").over(everything) * share[0] / share[1] - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    # The level rises as long as sources that reach their limit are set aside, and falls after that.
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return out.withColumn("target", target).select("source", "sid", "source_size", "weight", "target")


def thresholds(rows: DataFrame, budgets: DataFrame, levels: int = 3) -> DataFrame:
    """Hash threshold per source: (sid, threshold), so that rows below it sum to nearly the budget.

    rows: sid, size, key (a hash of ``levels * 12`` bits); budgets: sid, budget. A first histogram
    over all rows finds the bucket in which a source's budget ends; only that bucket's rows are
    counted again, twelve bits finer. The last unit is taken if that comes nearer to the budget.
    A larger budget never has a smaller threshold, so larger mixes hold the smaller ones.
    """
    bounds = budgets.select("sid", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, levels + 1):
        last = level == levels
        inside = rows.withColumn("bucket", F.shiftright("key", STEP * (levels - level)))
        if level > 1:
            inside = inside.withColumn("prefix", F.shiftright("bucket", STEP)).join(bounds.select("sid", "prefix"), ["sid", "prefix"], "left_semi")
        counted = inside.groupBy("sid", "bucket").agg(F.sum("size").alias("size")).join(bounds.select("sid", "budget", "below"), "sid")
        counted = counted.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("sid").orderBy("bucket")))
        stop = (2 * F.col("upto") - F.col("size") > 2 * F.col("budget")) if last else (F.col("upto") > F.col("budget"))
        ends = counted.groupBy("sid").agg(F.min(F.when(stop, F.struct("bucket", (F.col("upto") - F.col("size")).alias("under")))).alias("end"))
        bounds = bounds.join(ends, "sid", "left")
        if not last:
            # A source whose budget covers all its rows has no boundary (a null prefix) and is not counted again.
            bounds = bounds.select("sid", "budget", F.coalesce("end.under", "below").alias("below"), F.col("end.bucket").alias("prefix"))
    inner = F.coalesce(F.col("end.bucket"), (F.col("prefix") + 1) * (1 << STEP))
    return bounds.select("sid", F.when(F.col("prefix").isNull(), F.lit(1 << (STEP * levels))).otherwise(inner).alias("threshold"))


def mix_keys(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add __size (words) and __key (36 bits of a hash of id and size) to every row."""
    out = docs.withColumn("__size", word_count(text))
    named = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.col("__size").cast("string"))
    return out.withColumn("__key", F.conv(F.substring(F.md5(named), 1, 9), 16, 10).cast("long"))


def plan_mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """One row per source: source, source_size, target, base (copies of every row), threshold (one more below it).

    rows: source, size, key; read several times, so give a table that is cheap to read.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = cut_lineage(targets(totals, weights, share, most))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    aims = aims.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    keyed = rows.join(aims.select("sid", F.col("source").alias("__source")), rows["source"].eqNullSafe(F.col("__source"))).select("sid", "size", "key")
    return aims.join(thresholds(keyed, aims), "sid").select("source", "source_size", "target", "base", "threshold")


def apply_mix(rows: DataFrame, plan: DataFrame, most: int = 2, source: str = "source") -> DataFrame:
    """Add __source_size, __target and __copies to rows that have __size and __key; nothing is sorted or shuffled but the small plan."""
    plan = plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "base", "threshold")
    out = rows.join(plan, rows[source].eqNullSafe(F.col("__source")))
    copies = F.least(F.col("base") + (F.col("__key") < F.col("threshold")).cast("int"), F.lit(most))
    return out.withColumn("__copies", copies).drop("__source", "base", "threshold")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of every row: id, size, source_size, target, copies, taken.

    A row's size is its words. Targets are those of ``targets``. A source gets every row as often as
    its target holds whole copies of it, and once more the rows whose hash is below the source's
    threshold, so its sum is off by less than half of the one row at the boundary.

    Nulls: a null source is a source of its own, last in order; a null text has size 0; null ids share
    one hash per size. Rows with one id and size are taken or left together. Repeated rows count each.
    An empty table gives no rows; a source of size 0 has target 0. Other columns are not looked at.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = cut_lineage(mix_keys(rows, "id", "text").drop("text"))
    plan = plan_mix(rows.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")), weights, share, most)
    out = apply_mix(rows, plan, most)
    return out.select(F.col("id").alias(id), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))
