"""Sources: directories of CSV files, prepared tables, and the gold set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import position
from ..schemas import PAGING_COLUMNS, PORTION_SCORES

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "mode": "FAILFAST"}


def read_csv_dir(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    drop: Sequence[str] = PAGING_COLUMNS,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """All CSV files of a folder as one table without duplicates.

    ``schema`` lists the columns of the files. Whole rows are compared unless
    ``key`` names the columns that identify a row.
    """
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path).drop(*drop)
    return df.dropDuplicates(list(key)) if key else df.distinct()


def read_scores_typed(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = PORTION_SCORES):
    """The many small result files of scoring, read with explicit types in one scan."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, spread: bool = False, multiline: bool = False
) -> DataFrame:
    """One prepared table: Parquet by default, CSV when a schema is given.

    ``multiline`` is for CSV whose texts hold line breaks; such a file can not be split
    among tasks.

    ``spread`` is for tables of long texts: a table in fewer pieces than there are cores
    is redistributed first, because text work costs far more than moving the texts. A
    table in many pieces is left as it is.
    """
    if schema is None:
        df = spark.read.parquet(path)
    else:
        df = spark.read.options(**{**CSV_OPTIONS, "multiLine": str(multiline).lower()}).schema(schema).csv(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def read_gold_tsv(spark: SparkSession, path: str, names: Sequence[str] = ("tweet", "coarse", "fine")) -> DataFrame:
    """A tab-separated file without header or quoting, keyed by line number (from 1).

    Lines are ordered by file, block within the file and place within the block, and
    numbered without gathering them in one task.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    numbered = position(lines, [F.col("file"), F.col("block"), F.col("at")], "tweet_no")
    cells = F.split("line", "\t")
    return numbered.select(*[F.get(cells, i).alias(n) for i, n in enumerate(names)], "tweet_no")
