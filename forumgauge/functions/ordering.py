"""Order-dependent figures over a whole table: position, running total, moving mean.

A window without a partition key sends every row to one task. Here the table is
range-partitioned by the sort key instead, each range becomes a block, and only
one figure per block is combined globally. The ranges come from sampling, so the
blocked table is checkpointed before the figures are computed from it: a range
recomputed after an executor loss could otherwise be cut differently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import literal_rows

BLOCK = "__block"
CHUNK = "__chunk"


def _blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).withColumn(BLOCK, F.spark_partition_id())
    return cut_lineage(ranged)


def running_total(df: DataFrame, amount: Column, order: Sequence[Column], name: str, total: str | None = None):
    """Add the sum of ``amount`` up to and including each row in ``order``.

    ``order`` must be unique per row. ``total`` names a column for the grand total.
    """
    blocked = _blocks(df.withColumn("__amount", amount), order)
    sums = blocked.groupBy(BLOCK).agg(F.sum("__amount").alias("__sum"))
    # one row per block: at most spark.sql.shuffle.partitions rows
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        BLOCK,
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__sum").over(everything).alias("__total"),
    )
    within = Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        blocked.withColumn(name, F.sum("__amount").over(within))
        .join(F.broadcast(sums), BLOCK)
        .withColumn(name, F.col(name) + F.col("__before"))
    )
    if total:
        out = out.withColumnRenamed("__total", total)
    return out.drop(BLOCK, "__amount", "__before", "__total")


def position(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Number the rows 1, 2, ... in ``order`` (unique per row)."""
    return running_total(df, F.lit(1).cast("long"), order, name)


def at_positions(
    df: DataFrame, amount: Column, order: Sequence[Column], wanted: Callable[[int], Sequence[int]], name: str = "position"
) -> DataFrame:
    """The rows that cover given positions, counting from 0, when each row stands for
    ``amount`` (an integer) equal rows. ``wanted`` gets the total and names the positions.

    The sums of the blocks, one row each, tell which blocks hold a position; only those
    are sorted.
    """
    blocked = _blocks(df.withColumn("__amount", amount), order)
    sums = blocked.groupBy(BLOCK).agg(F.sum("__amount").alias("s")).orderBy(BLOCK).collect()
    positions = sorted(set(wanted(sum(r["s"] for r in sums))))
    holding, before = [], 0
    for row in sums:
        inside = [p for p in positions if before <= p < before + row["s"]]
        if inside:
            holding.append((row[BLOCK], before, inside))
        before += row["s"]
    names, schema = (BLOCK, "__before", "__inside"), f"{BLOCK} int, __before bigint, __inside array<bigint>"
    blocks = literal_rows(df.sparkSession, names, holding, schema)
    within = Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = blocked.join(F.broadcast(blocks), BLOCK).withColumn("__upto", F.col("__before") + F.sum("__amount").over(within))
    covered = F.filter("__inside", lambda p: (p >= F.col("__upto") - F.col("__amount")) & (p < F.col("__upto")))
    return ranked.withColumn(name, F.explode(covered)).drop(BLOCK, "__amount", "__before", "__inside", "__upto")


def moving_mean(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    rows: int,
    name: str,
    keys: Sequence[str] = (),
    chunk_rows: int = 65536,
) -> DataFrame:
    """Mean of each row and the ``rows - 1`` after it; null where fewer remain.

    The ordered table is cut into chunks by position and the first ``rows - 1`` rows
    of a chunk are lent to the chunk before, so every window is complete within one
    chunk and no task holds more than a chunk.
    """
    if chunk_rows < rows:
        raise ValueError("a chunk must hold at least one window")
    numbered = position(df, [*[F.col(k).asc() for k in keys], *order], "__pos")
    offset = F.col("__pos") - 1
    chunk = F.floor(offset / chunk_rows)
    lent = (offset % chunk_rows < rows - 1) & (chunk > 0)
    spread = numbered.withColumn(
        CHUNK, F.explode(F.when(lent, F.array(chunk, chunk - 1)).otherwise(F.array(chunk)))
    )
    ahead = Window.partitionBy(CHUNK, *keys).orderBy("__pos").rowsBetween(0, rows - 1)
    mean = F.when(F.count(value).over(ahead) == rows, F.avg(value).over(ahead))
    return spread.withColumn(name, mean).where(F.col(CHUNK) == chunk).drop("__pos", CHUNK)
