"""Top-k, sizes and ordered look-back that hold up when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket.session import cut_lineage

ROWS_PER_RANGE = 1_000_000  # a group of more rows is numbered in ranges of about so many
SAMPLED_PER_RANGE = 32
BROADCAST_BOUNDS = 200_000  # bounds of hot groups are broadcast up to this number, beyond it they are joined by a shuffle


def top_per_group(df: DataFrame, keys: Sequence, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` with a literal ``k`` is planned as a group limit before
    the shuffle and again after it: a task sends at most ``k`` rows per group, so
    a hot group never meets in one task as a whole.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_per_group(df, keys, order, 1)


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the number of rows of a row's group, without a window over the group. Null keys are a group too.

    Sizes come from a partially aggregated count, and only groups of two or more are joined back. A
    group with very many rows is on one side of the join only, so its partition can be split at run time.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
    sizes = sizes.select(F.col(name).alias("__size"), *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(F.col(f"__key{i}"))
    joined = df.join(sizes, same, "left").drop(*[f"__key{i}" for i in range(len(keys))])
    return joined.withColumn(name, F.coalesce("__size", F.lit(1).cast("bigint"))).drop("__size")


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> tuple[Column, DataFrame]:
    """Condition on equal keys, null equal to null, and ``other`` with its keys renamed for it."""
    renamed = other.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(renamed[f"__key{i}"])
    return same, renamed


def _reached(order: Sequence[tuple[str, bool]], bound: Column) -> Column:
    """Does the row come at or after ``bound`` in the order? Nulls first when ascending, last when descending, as in a sort."""
    out = F.lit(True)
    for name, descending in reversed(order):
        own, other = F.col(name), bound[name]
        later = (other.isNotNull() & own.isNull()) | (own < other) if descending else (other.isNull() & own.isNotNull()) | (own > other)
        out = F.coalesce(later, F.lit(False)) | (own.eqNullSafe(other) & out)
    return out


def order_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], hot: DataFrame, rows_per_range: int) -> tuple[DataFrame, bool]:
    """``df`` with ``__range``: for groups in ``hot`` (keys, n) the number of sampled bounds a row has reached, else null.

    Rows of a lower range come before all rows of a higher one. Also tells if the bounds are few enough to broadcast.
    """
    columns = [F.desc(c) if d else F.asc(c) for c, d in order]
    same, sizes = _null_safe(df, hot, keys)
    share = F.ceil(F.col("n") / rows_per_range) * SAMPLED_PER_RANGE / F.col("n")
    sample = df.join(F.broadcast(sizes) if hot.count() <= BROADCAST_BOUNDS else sizes, same).filter(F.rand(7) < share)
    placed = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))
    every = sample.select(*keys, *[c for c, _ in order if c not in keys], placed.alias("__at")).filter(F.col("__at") % SAMPLED_PER_RANGE == 0)
    bounds = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", F.struct(*[c for c, _ in order]).alias("b")))).alias("__bounds"))
    # The sample decides only where ranges are cut, not the result; it is kept so that all later steps see one cut.
    bounds = cut_lineage(bounds.withColumn("__bounds", F.transform("__bounds", lambda x: x["b"])))
    most, total = bounds.agg(F.coalesce(F.max(F.size("__bounds")), F.lit(0)), F.coalesce(F.sum(F.size("__bounds")), F.lit(0))).first()
    small = total <= BROADCAST_BOUNDS
    steps = [1 << i for i in range(int(most).bit_length() - 1, -1, -1)] or [1]
    # Binary search for the last bound reached.
    search = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= F.size("__bounds")) & _reached(order, F.get("__bounds", at + step - 1)), at + step).otherwise(at),
    )
    same, bounds = _null_safe(df, bounds, keys)
    ranged = df.join(F.broadcast(bounds) if small else bounds, same, "left").withColumn("__range", F.when(F.col("__bounds").isNotNull(), search))
    return ranged.drop("__bounds", *[f"__key{i}" for i in range(len(keys))]), small


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "rank", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Number all rows of every group in ``order`` (column, descending), however large a group is.

    Groups of up to ``rows_per_range`` rows are numbered by a plain window. A larger one is cut into ranges of its
    order by sampled bounds; ranges are numbered on their own, and the counts of the ranges before are added. So no
    task gets more than about one range of a hot group. The order should be total: rows that agree in all of it
    stay in one range. Null keys are a group.
    """
    columns = [F.desc(c) if d else F.asc(c) for c, d in order]
    hot = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_range))
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)).cast("bigint"))
    df = cut_lineage(df)  # it is read for the sample, the counts and the numbers
    ranged, small = order_ranges(df, keys, order, hot, rows_per_range)
    counts = ranged.filter("__range IS NOT NULL").groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__range", before.alias("__before"))
    local = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*columns)))
    same, starts = _null_safe(local, starts, [*keys, "__range"])
    joined = local.join(F.broadcast(starts) if small else starts, same, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: str, payload: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``previous`` and ``newest``: the row before in (ts, tie) order, and the last row of the key.

    Look-back inside one time bucket is a window per (key, bucket). Across buckets
    only one row per (key, bucket) is looked at, so a key with very many rows is
    spread over its buckets instead of being sorted in one task.
    """
    row = F.struct(*payload)
    df = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(ts, tie)
    local = df.withColumn("__lag", F.lag(row).over(inside))
    ends = df.groupBy(*keys, "__bucket").agg(F.max_by(row, F.struct(ts, tie)).alias("__end"))
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        *keys, "__bucket", F.lag("__end").over(by_bucket).alias("__before"), F.last("__end").over(whole).alias("newest")
    )
    joined = local.join(ends, [*keys, "__bucket"])
    return joined.withColumn("previous", F.coalesce("__lag", "__before")).drop("__lag", "__before", "__bucket")
