"""WARC records, and an audit of replicas by trees of hashes.

Pages become records, records become archives of at most 1,024 in their order. Each record
is a leaf with its hash, length and offset; an inner node hashes the ordered hashes and lengths
of a range of children. Two replicas are compared from the root down, and a level is looked
at only below nodes that differ, which leads to the records that are damaged, missing or added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of a record's place that each level of the tree leaves out: ranges of 32 records, archives of
#: 1,024, ranges of archives, parts of the table, and the root.
LEVELS = (5, 10, 20, 33, 63)
ARCHIVE = 10
DATE = "1970-01-01T00:00:00Z"


def record(id_col: str, url_col: str, body_col: str, date: str = DATE) -> Column:
    """The bytes of a resource record as text; null parts are empty."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``place, id, record``: every row as a record with its place, as a written table."""
    out = pages.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), record(id_col, url_col, body_col).alias("record"))
    return written(out, "records")


def leaves(held: DataFrame) -> DataFrame:
    """``place, hash, length, archive, offset`` of records: where each lies in its archive."""
    out = held.select(
        "place", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("length"),
        F.shiftright("place", ARCHIVE).alias("archive"),
    )
    before = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of the tree, leaves first, each ``place, hash, length`` with places of that level."""
    levels, passed = [leaf.select("place", "hash", "length")], 0
    for bits in LEVELS:
        below = levels[-1].withColumn("up", F.shiftright("place", bits - passed))
        listed = F.array_sort(F.collect_list(F.struct("place", "hash", "length")))
        text = F.concat_ws("\n", F.transform(listed, lambda c: F.concat_ws(" ", c.place.cast("string"), c.hash, c.length.cast("string"))))
        levels.append(written(below.groupBy("up").agg(F.sha2(text, 256).alias("hash"), F.sum("length").alias("length")).withColumnRenamed("up", "place"), "nodes"))
        passed = bits
    return levels


def differing(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """``place`` of the leaves in which two trees differ, found by descending from their roots."""
    shifts = [b - a for a, b in zip((0, *LEVELS[:-1]), LEVELS)]
    bad = None
    for level in range(len(mine) - 1, -1, -1):
        left, right = mine[level], other[level]
        if bad is not None:
            parents = bad.withColumnRenamed("place", "up")
            left, right = (t.withColumn("up", F.shiftright("place", shifts[level])).join(parents, "up", "left_semi") for t in (left, right))
        left = left.select("place", F.col("hash").alias("a"), F.col("length").alias("m"))
        right = right.select("place", F.col("hash").alias("b"), F.col("length").alias("n"))
        both = left.join(right, "place", "full")
        bad = written(both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("m").eqNullSafe(F.col("n")))).select("place"), "differing")
    return bad


def audit(held: DataFrame, replica: DataFrame) -> DataFrame:
    """``place, id, archive, offset, length, hash, intact`` of every record of ``held``, and of records only ``replica`` has.

    Both have ``place, id, record``. A record is intact if the replica has the same bytes at its
    place. A null record hashes as null and equals a null one only; empty tables give no rows;
    repeated pages have places of their own; other columns are not read.
    """
    mine, other = written(leaves(held), "leaves"), written(leaves(replica), "leaves")
    bad = differing(tree(mine), tree(other)).withColumn("intact", F.lit(False))
    own = mine.join(held.select("place", "id"), "place").join(bad, "place", "left")
    added = other.join(bad, "place").join(mine.select("place"), "place", "left_anti").join(replica.select("place", "id"), "place")
    columns = ["place", "id", "archive", "offset", "length", "hash"]
    return own.select(*columns, F.coalesce("intact", F.lit(True)).alias("intact")).unionByName(added.select(*columns, "intact"))
