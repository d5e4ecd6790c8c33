"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> DataFrame:
    """Persist a prepared table as Parquet and hand back the written table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_results_errors(df: DataFrame, path: str, error: str = "error", mode: str = "errorifexists"):
    """Write rows that succeeded and rows that failed to separate folders in one pass.

    Returns ``(results, errors)`` read back from ``outcome=results`` and
    ``outcome=errors`` below ``path``; the step that produced ``df`` runs once.
    """
    outcome = F.when(F.col(error).isNull(), "results").otherwise("errors")
    df.withColumn("outcome", outcome).write.mode(mode).partitionBy("outcome").parquet(path)
    written = df.sparkSession.read.schema(df.withColumn("outcome", F.lit("")).schema).parquet(path)
    results = written.where(F.col("outcome") == "results").drop("outcome", error)
    errors = written.where(F.col("outcome") == "errors").drop("outcome")
    return results, errors
