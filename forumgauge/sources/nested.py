"""Shaping of nested records and of column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snake_case


def drop_nested_columns(df: DataFrame) -> DataFrame:
    """Keep only columns a flat file can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, nested)])


def flatten_records(df: DataFrame, record: str, lists: Sequence[str] = ()) -> DataFrame:
    """Widen the struct column ``record`` into columns, then lengthen the array columns
    ``lists`` in parallel (a row without list entries stays, with null)."""
    rest = [c for c in df.columns if c != record]
    df = df.select(*rest, f"{record}.*")
    if not lists:
        return df
    zipped = F.explode_outer(F.arrays_zip(*lists)).alias("__item")
    df = df.select(*[c for c in df.columns if c not in lists], zipped)
    return df.select(*[c for c in df.columns if c != "__item"], *[F.col(f"__item.{c}") for c in lists])


def normalize_names(df: DataFrame) -> DataFrame:
    """snake_case for every column name; repeated names get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = snake_case(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
