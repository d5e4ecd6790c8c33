"""Helpers shared by the operators of this subpackage.

Texts are worked on in Arrow batches, cut into slices of bounded size, so that a
task's memory does not depend on how long the texts of a batch are taken together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumgauge.session import written

U64 = np.uint64
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(schema: T.StructType, *added: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` plus columns; a column of the same name is replaced."""
    names = {n for n, _ in added}
    return T.StructType([f for f in schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in added])


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and the last ends; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of ``inside`` bytes within each text.

    Returns starts, ends, and the index of each text's first word (plus the total).
    """
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base of polynomial hashes, or of its inverse, modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span, from one running sum."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * _power("up", n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mixed(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values (one per start; texts are not told apart here)."""
    starts = np.arange(max(0, len(values) - size + 1))
    return span_hashes(values, starts, starts + size)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column_of(batch: pa.RecordBatch, name: str, kind: pa.DataType | None = None) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.cast(kind) if kind is not None else out


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges`` (columns a, b).

    Alternates two steps that hang neighbours onto the smallest one, first the larger
    neighbours and then the smaller ones, until the edges are stars. Minima are combined
    before each shuffle; every round is written to the shared folder. An empty table has
    no rows; null ends and loops are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if state == seen or not state[0]:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


class Sets:
    """Disjoint sets over positions; a set is named by its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join pairs; pairs already known to be together cost no Python step."""
        while len(left):
            root = self.roots()
            apart = root[left] != root[right]
            left, right = left[apart], right[apart]
            for i, j in zip(left[:4096].tolist(), right[:4096].tolist()):
                i, j = self._find(i), self._find(j)
                if i != j:
                    self.parent[max(i, j)] = min(i, j)
            left, right = left[4096:], right[4096:]

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def tiled(df: DataFrame, keys: list[str], most: int, row: str) -> DataFrame:
    """Split groups of over ``most`` rows into pairs of tiles that separate tasks compare.

    A group of n rows becomes ceil(n / most) parts; a row goes to each pair of parts that
    has its own. ``tile`` names the pair, ``part`` is the row's own part. Groups of one row are
    dropped. Two rows of a group meet in exactly one tile in which they are to be compared:
    the pair of their parts.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / most).cast("int")
    own = df.join(sizes, keys).withColumn("parts", parts).drop("n")
    own = own.withColumn("part", F.pmod(F.xxhash64(F.col(row)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pair = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    return own.withColumn("other", other).withColumn("tile", pair.cast("long")).drop("other", "parts")


def groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted batches, regrouped so that no group of ``keys`` is cut; a table has about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = np.zeros(whole.num_rows, bool)
        for k in keys:
            values = whole.column(k).to_numpy()
            last[1:] |= values[1:] != values[:-1]
        cut = np.flatnonzero(last)
        if len(cut):
            yield whole.slice(0, int(cut[-1]))
            whole = whole.slice(int(cut[-1]))
        held, count = whole.to_batches(), whole.num_rows
    if count:
        yield pa.Table.from_batches(held)
