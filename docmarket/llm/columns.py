"""Columns of any table by exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``new=old`` columns of ``df`` and no others.

    Names are matched exactly, so ``Text`` beside ``text`` is no clash; of columns of one name the first counts.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    missing = [name for name in wanted.values() if name not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"c{at[old]}").alias(new) for new, old in wanted.items()])
