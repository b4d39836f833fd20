"""Readers for the Parquet tables and small literal tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


# Tables whose rows are long texts: the work per row is large compared with moving it.
TEXT_TABLES = ("documents", "pages", "conversations")
ROWS_PER_TASK = 500_000  # rows that a task sorts or hashes at once, where a table is dealt by its keys


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores.

    A small file is one split, and one core would parse all its texts. A table of many
    files has more splits than cores and is left as it is: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows that agree in ``keys`` together, in so many tasks that each gets about ``ROWS_PER_TASK`` of ``rows``.

    What a task holds then does not grow with the table. Tables that meet by these keys are dealt by the same ``rows``,
    the larger count, so that a join or a group finds them in place. What the cores hold at that rate is left to Spark.
    """
    tasks = math.ceil(rows / ROWS_PER_TASK)
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def values_frame(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A small lexicon as a local relation.

    A local relation carries its exact size, so Spark's own size check decides
    whether a join broadcasts it; no hint is needed.
    """
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
