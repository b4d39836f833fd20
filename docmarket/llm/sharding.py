"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docmarket.session import cut_lineage


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 16, overhead: int = 16, rows_per_part: int = 50_000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row: ``id``, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts are never parted. Rows are ordered by the hash of their text and gathered into
    ``2**bits`` atomic groups, so that the search for the smallest capacity works on one bounded
    array however large the table is; a shard's size is exact to one such group. Slots count from 0
    within a shard: by group, in a group of over ``rows_per_part`` rows by hashed parts, then by ``id``.

    Nulls: a null text is an empty text (size = ``overhead``); a null id is kept and comes first.
    Repeated rows keep one slot each. An empty table gives no rows. Other columns are not looked at.
    Only ids, sizes and checksums are shuffled, so long texts stay where they are; a group with very many rows is
    numbered in parts, rows that agree in everything included.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - bits).cast("int").alias("unit"),
    )
    rows = cut_lineage(rows)
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    placed = cut_units(units, shards).withColumn("parts", F.ceil(F.col("n") / rows_per_part).cast("int"))
    rows = split_groups(rows, placed, rows_per_part)
    # A piece of a group is numbered on its own; the pieces' sizes give where its numbers start.
    piece = ["unit", "part", "piece"]
    per_piece = rows.groupBy("shard", *piece).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_piece.select(*piece, before.alias("start"))
    within = F.row_number().over(Window.partitionBy(*piece).orderBy("id", "size", "text_crc32")) - 1
    out = rows.withColumn("within", within).join(starts, piece)
    return out.select(
        F.col("id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def split_groups(rows: DataFrame, placed: DataFrame, rows_per_part: int) -> DataFrame:
    """Add shard, part and piece to checkpointed rows (id, size, text_crc32, unit).

    Parts of a group are chosen by the row's own values, so reruns agree. Rows that agree in all of them
    share a part; one that has grown past twice ``rows_per_part`` is cut into pieces by a number of the row.
    """
    part = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.col("parts")).cast("int")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.join(placed.select("unit", "shard", "parts"), "unit").withColumn("part", part).drop("parts")
    pieces = rows.groupBy("unit", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * rows_per_part)).cast("int").alias("pieces"))
    return rows.join(pieces, ["unit", "part"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces", "row")


# One pass over the array: how many shards of at most the middle capacity the units need.
_NEEDED = """aggregate(u, named_struct('n', 1, 'fill', 0L), (s, x) -> IF(s.fill + x.size > (b.low + b.high) DIV 2,
    named_struct('n', s.n + 1, 'fill', x.size), named_struct('n', s.n, 'fill', s.fill + x.size)), s -> s.n)"""
_CAPACITY = f"""aggregate(sequence(1, 64), named_struct('low', low, 'high', low + largest), (b, i) -> CASE WHEN b.low >= b.high THEN b
    WHEN {_NEEDED} <= shards THEN named_struct('low', b.low, 'high', (b.low + b.high) DIV 2)
    ELSE named_struct('low', (b.low + b.high) DIV 2 + 1, 'high', b.high) END, b -> b.high)"""
# Packed from the end: element k - 1 is the first unit from which the rest fits into k shards.
_LATEST = """aggregate(reverse(u), named_struct('fill', 0L, 'at', size(u), 'cuts', CAST(array() AS array<int>)), (s, x) -> IF(s.fill + x.size > capacity,
    named_struct('fill', x.size, 'at', s.at - 1, 'cuts', concat(s.cuts, array(s.at))),
    named_struct('fill', s.fill + x.size, 'at', s.at - 1, 'cuts', s.cuts)), s -> concat(s.cuts, array(s.at)))"""
# Close a shard where it would pass the capacity, or where it is nearest to its share of what is left and the rest still fits.
_CUTS = """aggregate(u, named_struct('at', 0, 'open', shards, 'left', total, 'fill', 0L, 'cuts', CAST(array() AS array<int>)), (s, x) -> IF(
    s.at > 0 AND (s.fill + x.size > capacity OR (s.open > 1 AND (2 * s.fill + x.size) * s.open > 2 * s.left AND s.at >= coalesce(get(latest, s.open - 2), 0))),
    named_struct('at', s.at + 1, 'open', s.open - 1, 'left', s.left - s.fill, 'fill', x.size, 'cuts', concat(s.cuts, array(s.at))),
    named_struct('at', s.at + 1, 'open', s.open, 'left', s.left, 'fill', s.fill + x.size, 'cuts', s.cuts)), s -> s.cuts)"""


def cut_units(units: DataFrame, shards: int) -> DataFrame:
    """Place units (unit, size, n) into shards: unit, n, shard, contiguous in the order of unit.

    The units' sizes are one array in one row. The smallest capacity is found by bisection with a
    greedy check. The cuts then aim at equal shares of what is left, but never above that capacity.
    """
    u = F.sort_array(F.collect_list(F.struct("unit", F.col("size").cast("long").alias("size"), "n")))
    row = units.agg(u.alias("u"), F.sum("size").cast("long").alias("total"), F.max("size").cast("long").alias("largest")).filter(F.size("u") > 0)
    row = row.withColumn("shards", F.lit(shards)).withColumn("low", F.greatest("largest", F.ceil(F.col("total") / shards).cast("long")))
    row = row.withColumn("capacity", F.expr(_CAPACITY)).withColumn("latest", F.expr(_LATEST)).withColumn("cuts", F.expr(_CUTS))
    placed = F.transform("u", lambda x, i: F.struct(x["unit"].alias("unit"), x["n"].alias("n"), F.size(F.filter("cuts", lambda c: c <= i)).alias("shard")))
    return row.select(F.explode(placed).alias("x")).select("x.*")
