"""Joins on keys that may be null, and attaching per-group figures without a window.

A window over a group puts the whole group into one task. When a group can hold a
third of the table, a map-side combined aggregate joined back is the safer plan:
the aggregate is one row per group, and a hot key on the large side is split by
the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null equals null; key columns appear once, from the left."""
    renamed = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    condition = [left[k].eqNullSafe(right[r]) for k, r in renamed.items()]
    return left.join(right, condition, how).drop(*renamed.values())


def attach(df: DataFrame, keys: Sequence[str], **figures) -> DataFrame:
    """Add per-group aggregates (``name=aggregate column``) to every row."""
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in figures.items()])
    return join_null_safe(df, grouped, keys, "inner")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group in an order, with their rank from 1.

    Every input partition ranks its own part of a group first, so no task sorts more than
    ``n`` rows of a group from each partition, however large ``n`` or the group is.
    """
    part = Window.partitionBy(*keys, "__part").orderBy(*order)
    own = df.withColumn("__part", F.spark_partition_id()).withColumn("__own", F.row_number().over(part))
    near = own.where(F.col("__own") <= n).drop("__part", "__own")
    return near.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def single(df: DataFrame):
    """The only value of a one-row, one-column frame, as a scalar subquery."""
    return df.scalar()


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A handful of driver-side rows as a table that needs no Python worker."""
    if not rows:
        return spark.createDataFrame([], schema)
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
