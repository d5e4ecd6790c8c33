"""Near-duplicate documents by SimHash, compared as vertical bit planes.

Every document gets a 64-bit fingerprint of its word shingles. Fingerprints within the
radius agree in two of six bit fields (four differing bits can touch four fields at
most), so equal pairs of fields bring candidates together. Inside a task, the sorted
candidates are stored as 64 bit planes; one shift of all planes by d lanes compares
every lane with the lane d further on, differing bits are added up in carry-save
counters, and words of lanes that all exceed the radius are abandoned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Sets, column_of, components, groups, slices, tiled, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: First bit and width of six fields that cover 64 bits.
FIELDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 2048


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: bits set in over half the shingle hashes; no words: zero."""
    words = text.lower().split()  # of bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle]))
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 14):
        total += np.unpackbits(bits[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(bits)).tobytes(), "big")


def text_print(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, print, fingerprint`` (long, the 64 bits) of every row; ``print`` is a hash of the text, null as empty."""

    def work(batches):
        for part in slices(batches, "text"):
            texts = column_of(part, "text").to_pylist()
            found = np.array([fingerprint_of((t or "").encode()) for t in texts], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column_of(part, "id"), column_of(part, "print"), pa.array(found)], ["id", "print", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_print(text_col).alias("print"))
    return out.mapInArrow(work, f"id {kind}, print long, fingerprint long").withColumnRenamed("id", id_col)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of word w in row b is bit b of value 64 w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, U64)
    padded[: len(values)] = values
    cells = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(cells.T), axis=1, bitorder="little")).view(U64)


def packed(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(U64)


def shifted(plane: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """The chosen words of a plane (last axis) whose lanes are moved down by ``by``."""
    skip, rest = divmod(by, 64)
    size = plane.shape[-1]
    low = np.take(plane, np.minimum(words + skip, size - 1), axis=-1)
    if not rest:
        return low
    high = np.take(plane, np.minimum(words + skip + 1, size - 1), axis=-1)
    return (low >> U64(rest)) | (high << U64(64 - rest))


def near_lanes(planes: np.ndarray, wanted: np.ndarray, by: int, radius: int = RADIUS) -> np.ndarray:
    """Lanes i among ``wanted`` (packed) whose value is within ``radius`` of the value at i + by.

    Differing bits are counted in three carry-save planes and a sticky overflow plane.
    """
    words = np.flatnonzero(wanted)
    ones = np.zeros(len(words), U64)
    twos, fours, over, alive = ones.copy(), ones.copy(), ones.copy(), wanted[words]
    for first in range(0, 64, 8):
        differ = planes[first : first + 8][:, words] ^ shifted(planes[first : first + 8], words, by)
        for x in differ:
            carry = ones & x
            ones = ones ^ x
            carry, twos = twos & carry, twos ^ carry
            carry, fours = fours & carry, fours ^ carry
            over = over | carry
        beyond = over.copy()
        for count in range(radius + 1, 8):
            beyond |= (ones if count & 1 else ~ones) & (twos if count & 2 else ~twos) & (fours if count & 4 else ~fours)
        alive = alive & ~beyond
        keep = np.flatnonzero(alive)
        if len(keep) < len(words):
            words, ones, twos, fours, over, alive = (a[keep] for a in (words, ones, twos, fours, over, alive))
        if not len(words):
            return np.zeros(0, np.int64)
    lanes = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    row, lane = np.nonzero(lanes)
    return words[row] * 64 + lane


def block_links(values: np.ndarray, group: np.ndarray, part: np.ndarray, crossing: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each lane, the first lane of its component within its group.

    ``group`` is sorted. Lanes are compared within a group; where ``crossing`` holds, only
    lanes of different ``part``.
    """
    n, sets = len(values), Sets(len(values))
    planes, by = bit_planes(values), 1
    live = np.arange(n)
    while True:
        live = live[live < n - by]
        live = live[group[live] == group[live + by]]
        if not len(live):
            return sets.roots()
        use = live[~crossing[live] | (part[live] != part[live + by])]
        if len(use):
            flags = np.zeros(n, bool)
            flags[use] = True
            found = near_lanes(planes, packed(flags), by, radius)
            sets.join(found, found + by)
        by += 1


def candidate_keys(prints: DataFrame) -> DataFrame:
    """A row for each pair of fields: ``pair`` and ``bits``, the values of both fields."""
    wide = lambda at: F.shiftrightunsigned("fingerprint", FIELDS[at][0]).bitwiseAND(F.lit((1 << FIELDS[at][1]) - 1))
    keys = [
        F.struct(F.lit(k).alias("pair"), (F.shiftleft(wide(a), 11) + wide(b)).alias("bits"))
        for k, (a, b) in enumerate(combinations(range(len(FIELDS)), 2))
    ]
    return prints.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.pair", "k.bits")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` that connect exactly the fingerprints connected by links within ``radius``.

    ``prints`` has distinct fingerprints. Per tile at most one edge per fingerprint is given,
    so a group of n near copies gives about n edges, not n squared.
    """
    if not 0 <= radius <= 4:
        raise ValueError("six fields taken in pairs find all links for a radius of 0 to 4")

    def work(batches):
        for block in groups(batches, ["pair", "bits", "tile"]):
            values = block.column("fingerprint").to_numpy()
            new = np.ones(len(values), bool)
            new[1:] = False
            for k in ("pair", "bits", "tile"):
                c = block.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            group, part = np.cumsum(new), block.column("part").to_numpy()
            lowest = np.minimum.reduceat(part, np.flatnonzero(new))
            highest = np.maximum.reduceat(part, np.flatnonzero(new))
            crossing = (lowest != highest)[group - 1]
            root = block_links(values.view(U64), group, part, crossing, radius)
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(values[tied]), pa.array(values[root[tied]])], ["a", "b"])

    cells = tiled(candidate_keys(prints), ["pair", "bits"], TILE, "fingerprint")
    cells = cells.repartition("pair", "bits", "tile").sortWithinPartitions("pair", "bits", "tile")
    return cells.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id reachable by links of
    at most ``radius`` differing bits. Null and empty texts have fingerprint zero and are
    linked like any other; repeated rows are returned once each; a null id is no candidate
    for ``component_id`` unless it is alone. Other columns are not read. An empty table gives no rows.
    """
    prints, named = rooted(docs, id_col, text_col, radius)
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(known, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def rooted(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``fingerprint, first, root`` of the different ones: smallest id and component."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    unique = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "fingerprints")
    tied = components(links(unique, radius)).withColumnRenamed("node", "fingerprint")
    return prints, unique.join(tied, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component, with all its columns.

    A row without an id stays only if its component has no other; of rows with the same id,
    and of repeated rows, one stays.
    """
    prints, named = rooted(docs, id_col, text_col, radius)
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "print")
    best = prints.join(named, "fingerprint").groupBy("root").agg(F.min(row).alias("b")).select(
        F.col("b.none").alias("__none"), F.coalesce(F.col("b.id").cast("string"), F.lit("")).alias("__id"), F.col("b.print").alias("__print"))
    keys = ["__none", "__id", "__print"]
    keyed = docs.withColumns({
        "__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__print": text_print(text_col)})
    return keyed.join(best, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
