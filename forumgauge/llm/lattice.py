"""Near-duplicate vectors by lattice hashing.

A vector's direction is projected at random to eight dimensions and decoded to the nearest
point of the E8 lattice; its cell and the nearest neighbouring cells, in several tables, are
where it is placed. Vectors that meet in a cell are compared by cosine in double precision.
Different vectors only are placed, with how many rows have each. A cell with very many vectors
is compared in pairs of tiles by separate tasks. A tile gives a number of links and one edge for
each vector, never its pairs; a pair that meets in several cells is counted in the first.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Sets, as_long, column_of, components, groups, mixed, tiled, written

COSINE = 0.95
TABLES = 4
PROBES = 3
#: Length of a unit vector after projection, against a lattice whose least distance is the root of two.
SCALE = 2.5
TILE = 512
SEED = 42


def decode(x: np.ndarray) -> np.ndarray:
    """Twice the nearest point of E8 for each row of eight numbers (so that halves are whole)."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two units, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = np.zeros(8, np.int64)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(units: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the cells each row is placed in: its own and its nearest, by table."""
    out = np.empty((len(units), tables, probes + 1), U64)
    for t in range(tables):
        way = np.random.default_rng([seed, t, units.shape[1]]).standard_normal((units.shape[1], 8)) / np.sqrt(8)
        x = units @ way * SCALE
        own = decode(x)
        toward = (2 * x - own) @ neighbours().T
        nearest = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + neighbours()[nearest]], axis=1)
        h = np.full(points.shape[:2], t * 1000003 + units.shape[1], U64)
        for k in range(8):
            h = mixed(h ^ (points[..., k].astype(U64) + U64(k << 32)))
        out[:, t] = h
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, at: int, cell: np.uint64) -> np.ndarray:
    """Whether rows of placements meet in table ``at`` and ``cell`` and nowhere before."""
    same = (a[:, : at + 1, :, None] == b[:, : at + 1, None, :]).any(axis=3)
    before = same[:, :at].any(axis=(1, 2))
    least = np.where(same[:, at], a[:, at], U64(2**64 - 1)).min(axis=1)
    return ~before & (least == cell)


def tile_links(units: np.ndarray, places: np.ndarray, part: np.ndarray, at: int, cell: np.uint64, size: np.ndarray, cosine: float):
    """For each row of a tile, links counted here and the first row of its component here."""
    near = units @ units.T >= cosine
    if part.min() != part.max():
        near &= part[:, None] != part[None, :]
    left, right = np.nonzero(np.triu(near, 1))
    count, sets = np.zeros(len(units), np.int64), Sets(len(units))
    for k in range(0, len(left), 1 << 14):
        i, j = left[k : k + (1 << 14)], right[k : k + (1 << 14)]
        new = first_meeting(places[i], places[j], at, cell)
        np.add.at(count, i[new], size[j[new]])
        np.add.at(count, j[new], size[i[new]])
        sets.join(i, j)
    return count, sets.roots()


def _usable(v):
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
    tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row of ``vectors``.

    Links are pairs of rows with a cosine of at least ``cosine`` that the cells bring together;
    rows of one vector are linked with each other. ``component_id`` is the smallest id reachable,
    ``kept`` marks the row that has it. Vectors that are null, empty, zero or hold null or non-finite
    numbers, and rows without an id, have no links and are their own component. Vectors of
    different length are never linked. Repeated rows are separate vectors; other columns are not
    read; an empty table gives no rows.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = _usable(F.col("v")) & F.col("id").isNotNull()
    classes = source.where(usable).groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")

    def place(batches):
        for batch in batches:
            rows = column_of(batch, "v")
            wide = np.diff(rows.offsets.to_numpy())
            for d in np.unique(wide).tolist():
                some = batch.take(pa.array(np.flatnonzero(wide == d)))
                x = np.stack(column_of(some, "v").to_numpy(zero_copy_only=False)).astype(float)
                for k in range(0, len(x), 4096):
                    part = some.slice(k, 4096)
                    found = as_long(cells(unit(x[k : k + 4096]), tables, probes)).reshape(part.num_rows, -1)
                    yield pa.RecordBatch.from_arrays(
                        [*(column_of(part, c) for c in ("class", "size", "v")), pa.array(list(found), pa.list_(pa.int64()))],
                        ["class", "size", "v", "places"])

    def compare(batches):
        for block in groups(batches, ["at", "cell", "tile"], rows=4096):
            new = np.zeros(block.num_rows, bool)
            new[0] = True
            for k in ("at", "cell", "tile"):
                c = block.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            bounds = np.append(np.flatnonzero(new), block.num_rows).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                rows = block.slice(a, b - a)
                name, size = rows.column("class").to_numpy(), rows.column("size").to_numpy()
                places = np.array(rows.column("places").to_pylist(), np.int64).view(U64).reshape(b - a, tables, probes + 1)
                units = unit(np.array(rows.column("v").to_pylist(), float))
                at, cell = rows.column("at")[0].as_py(), rows.column("cell").to_numpy()[:1].view(U64)[0]
                count, root = tile_links(units, places, rows.column("part").to_numpy(), at, cell, size, cosine)
                some = np.flatnonzero((count > 0) | (root != np.arange(b - a)))
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(count[some]), pa.array(name[root[some]])], ["class", "n", "root"])

    placed = classes.select("class", "size", "v").mapInArrow(place, "class long, size long, v array<double>, places array<long>")
    met = placed.select("*", F.posexplode("places").alias("turn", "cell")).withColumn("at", F.floor(F.col("turn") / (probes + 1)).cast("int")).drop("turn")
    tiles = tiled(met, ["at", "cell"], TILE, "class").repartition("at", "cell", "tile").sortWithinPartitions("at", "cell", "tile")
    found = written(tiles.mapInArrow(compare, "class long, n long, root long"), "links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    tied = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = classes.join(tied, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    known = named.join(lowest, "root").join(counts, "class", "left").select(
        F.col("v").alias("known_v"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = source.withColumn("usable", usable)
    out = out.join(known, F.col("usable") & (out["v"] == known["known_v"]), "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
