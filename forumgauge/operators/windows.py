"""Order-dependent operators. See ``functions.ordering`` for how a whole table is
ordered without passing through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering
from ..functions.keys import attach, first_rows, join_null_safe, single


def rolling_mean(
    df: DataFrame,
    value: str = "prop_offense",
    order: Sequence[Column] | None = None,
    rows: int = 15,
    output: str = "rolling_mean",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean over this row and the ``rows - 1`` before it in time (rows, not days).

    The order is newest first with a unique tie-break, and rows near the oldest end,
    whose window is short, get null. ``keys`` keeps series apart.
    """
    order = order or [F.col("date").desc(), F.col("video_id").asc()]
    return ordering.moving_mean(df, value, order, rows, output, keys)


def cumulative_share(df: DataFrame, n: str = "n", key: str = "author_id") -> DataFrame:
    """Percent of the total per row and running percent, largest first (ties by key)."""
    order = [F.col(n).desc(), F.col(key).asc_nulls_first()]
    ranked = ordering.running_total(df, F.col(n), order, "__upto", total="__all")
    share = lambda c: F.try_divide(F.col(c) * F.lit(100.0), "__all")
    return ranked.withColumns({"percent": share(n), "cum_percent": share("__upto")}).drop("__upto", "__all")


def top_n_per_group(df: DataFrame, value: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows of each group and everything tied with the last of them.

    First the n-th largest value per group is found, for which every task hands on at
    most n rows per group; then the rows reaching that value are kept. Ties, however
    many, are never gathered in one place.
    """
    df = df.where(F.col(value).isNotNull())
    if not keys:
        smallest = df.select(value).orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("cut"))
        return df.where(F.col(value) >= single(smallest))
    largest = first_rows(df.select(*keys, value), keys, [F.desc(value)], n, "__r")
    cut = largest.groupBy(*keys).agg(F.min(value).alias("__cut"))
    return join_null_safe(df, cut, keys, "inner").where(F.col(value) >= F.col("__cut")).drop("__cut")


def argmax_rows(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the maximum of their group, or of the table; ties are kept."""
    if not keys:
        return df.where(F.col(value) == single(df.agg(F.max(value).alias("top"))))
    return attach(df, keys, __top=F.max(value)).where(F.col(value) == F.col("__top")).drop("__top")


def share_in_group(df: DataFrame, keys: Sequence[str], value: str = "n", output: str = "share") -> DataFrame:
    """Value divided by the sum over its group."""
    return attach(df, keys, __sum=F.sum(value)).withColumn(output, F.try_divide(value, "__sum")).drop("__sum")


def row_index(df: DataFrame, order: Sequence[Column], output: str = "row_no") -> DataFrame:
    """Sequential key 1, 2, ... in a unique order."""
    return ordering.position(df, order, output)
