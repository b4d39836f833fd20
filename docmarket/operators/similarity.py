"""Similarity of short strings by recursive longest matching blocks, for many pairs at once."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docmarket.functions import text as T

PAIRS_AT_ONCE = 4096


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, padded to one width, and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def matched_chars(left: list[str], right: list[str]) -> np.ndarray:
    """Characters of each pair in matching blocks: the longest common substring (of equally long ones the first in
    ``left``, then in ``right``), and in turn the longest ones of the stretches before and after it."""
    out = np.zeros(len(left), np.int64)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        out[at : at + PAIRS_AT_ONCE] = _matched(left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE])
    return out


def _matched(left: list[str], right: list[str]) -> np.ndarray:
    (a, a_size), (b, b_size) = _codes(left), _codes(right)
    total = np.zeros(len(left), np.int64)
    zero = np.zeros(len(left), np.int64)
    items = np.stack((np.arange(len(left)), zero, a_size, zero, b_size))  # pair, stretch of left, stretch of right
    while True:
        items = items[:, (items[1] < items[2]) & (items[3] < items[4])]
        if not items.shape[1]:
            return total
        pair, a_low, a_high, b_low, b_high = items
        rows, width = (a_high - a_low).max(), (b_high - b_low).max()
        place = b_low[:, None] + np.arange(width)
        inside = place < b_high[:, None]
        other = b[pair[:, None], np.minimum(place, b.shape[1] - 1)]
        run = np.zeros((len(pair), width + 1), np.int64)  # length of the common run that ends at each place
        best, best_a, best_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(rows):
            at = a_low + i
            equal = inside & (at < a_high)[:, None] & (other == a[pair, np.minimum(at, a.shape[1] - 1)][:, None])
            run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
            end = run.argmax(1)
            length = run[np.arange(len(pair)), end]
            more = length > best
            best[more], best_a[more], best_b[more] = length[more], (at - length + 1)[more], (b_low + end - length)[more]
        np.add.at(total, pair, best)
        hit = best > 0
        before = np.stack((pair, a_low, best_a, b_low, best_b))[:, hit]
        after = np.stack((pair, best_a + best, a_high, best_b + best, b_high))[:, hit]
        items = np.concatenate((before, after), axis=1)


def block_ratio(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters; 1 for two empty strings."""
    size = np.fromiter((len(x) + len(y) for x, y in zip(left, right)), np.int64, len(left))
    return np.where(size > 0, 2.0 * matched_chars(left, right) / np.maximum(size, 1), 1.0)


def _with_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``__ratios`` of the label with every candidate beside it."""
    for batch in batches:
        known = [[x["name"] for x in c] for c in batch["__near"].to_pylist()]
        label = batch["__label"].to_pylist()
        found = block_ratio([x for c in known for x in c], [x for x, c in zip(label, known) for _ in c])
        ends = np.concatenate(([0], np.cumsum([len(c) for c in known]))).astype(np.int32)
        yield batch.append_column("__ratios", pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.float64())))


def add_closest(df: DataFrame, out: str, label: Column, names: Mapping[str, str], bar: Callable[[Column], Column], wanted: Column | None = None) -> DataFrame:
    """Add struct(ratio, name, value) of the name most similar to ``label`` with a ratio of at least ``bar(label)``, else null.

    Equally similar names: the last in code-point order. The list of names is bounded; a name is compared only if
    lengths and then character counts, both upper bounds of the ratio, allow it. Null or empty labels, and rows
    where ``wanted`` is false, are compared with nothing. Meant for distinct labels: what is left goes through Arrow.
    """
    rows = [{"name": n, "value": v, "size": len(n), "chars": [{"c": c, "n": k} for c, k in sorted(Counter(n).items())]} for n, v in sorted(names.items()) if n]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<name string, value string, size int, chars array<struct<c string, n int>>>>")

    def possible(c: Column, size: Column, least: Column) -> Column:
        allowed = lambda n, x: 2 * n / (size + x["size"]) >= least
        common = lambda x: F.aggregate(x["chars"], F.lit(0), lambda n, y: n + F.least(y["n"], size - F.length(F.replace(c, y["c"], F.lit("")))))
        near = F.filter(F.filter(table, lambda x: allowed(F.least(size, x["size"]), x)), lambda x: allowed(common(x), x))
        return F.transform(near, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), least.cast("double").alias("least")))

    asked = (F.length(label) > 0) if wanted is None else (F.length(label) > 0) & wanted
    near = F.when(F.coalesce(asked, F.lit(False)), T.let(label, lambda c: T.let(F.length(c), lambda size: T.let(bar(c), lambda least: possible(c, size, least)))))
    none = F.from_json(F.lit("[]"), "array<struct<name string, value string, least double>>")
    held = df.withColumns({"__label": label, "__near": F.coalesce(near, none)})
    scored = held.mapInArrow(_with_ratios, StructType([*held.schema, StructField("__ratios", ArrayType(DoubleType()))]))
    pairs = F.zip_with("__ratios", "__near", lambda r, x: F.when(r >= x["least"], F.struct(r.alias("ratio"), x["name"].alias("name"), x["value"].alias("value"))))
    return scored.withColumn(out, F.array_max(pairs)).drop("__label", "__near", "__ratios")
