"""Set operations and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import count_by
from .text import explode_term_list


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Append tables by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "origin") -> DataFrame:
    """Append tables, each row tagged with the name of its table."""
    return union_by_name(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or the distinct combinations of some columns."""
    return df.select(*columns).distinct() if columns else df.distinct()


def shared_terms(df: DataFrame, column: str = "terms") -> DataFrame:
    """How many of the listed topics share each term."""
    return count_by(explode_term_list(df.select(column), column, "term"), "term")


def pivot_wider(df: DataFrame, ids: Sequence[str], names: str, values: str, domain: Sequence, prefix: str = ""):
    """Long to wide for a known list of names."""
    wide = df.groupBy(*ids).pivot(names, list(domain)).agg(F.first(values))
    return wide.withColumnsRenamed({str(d): f"{prefix}{d}" for d in domain})


def pivot_longer(df: DataFrame, ids: Sequence[str], columns: Sequence[str], names: str = "metric", values: str = "value"):
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), names, values)


def unnest_lists(df: DataFrame, column: str, output: str, keep_empty: bool = False) -> DataFrame:
    """One row per list element; a row with an empty list stays if ``keep_empty``."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, (F.explode_outer if keep_empty else F.explode)(column).alias(output))


def separate_column(df: DataFrame, column: str, into: Sequence[str], sep: str = "_", integers: Sequence[str] = ()):
    """Split a text column; missing parts, and parts that are no integer, become null."""
    parts = F.split(column, sep)
    pieces = {n: F.get(parts, i) for i, n in enumerate(into)}
    return df.withColumns({n: c.try_cast("int") if n in integers else c for n, c in pieces.items()})
