"""Packing of tokenised documents into sequences by bin completion.

Documents longer than a sequence are cut; everything else is placed whole. Pieces of the
same length are interchangeable, so the search works on the number of pieces of each
length: a table of at most ``capacity`` rows whatever the corpus. Around the largest
length left, it enumerates undominated fillings of the rest of the sequence, best fit
first as incumbent, prunes those that can not waste less, and uses the winner as often as
its lengths last. Pieces then find their place by their rank within their length, which is
counted in salted groups, so that no length is gathered in one task.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, slices, written

CAPACITY = 2048
SALTS = 256
#: Fillings looked at around one largest length before the best so far is taken.
FILLINGS = 4000
#: Units whose ids a task keeps; beyond, it starts afresh.
UNITS = 800_000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts by a byte-level BPE file of the tokenizers library.

    Such a tokenizer splits between a visible character and white space before it merges,
    so a text is the sum of its units (a blank with the word behind it), whose ids are
    remembered. ``ranks`` may name the same vocabulary as ranks: units of Latin letters are
    then encoded by the faster tiktoken, and a part of each lot by both, which must agree.
    """

    _odd = re.compile(r"\s\s|[^\S \n]")
    _cut = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.units: dict[str, bytes] = {}

    def _by_library(self, units: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(units, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, units: set[str]) -> None:
        """Ids of all units; an empty one stands for a line break."""
        if len(self.units) + len(units) > UNITS:
            self.units.clear()
        new = [u for u in units if u not in self.units]
        plain = [u for u in new if max(u, default="") < "\u0250" and "<|" not in u and u] if self.fast else []
        for unit in plain:
            self.units[unit] = array("I", self.fast.encode_ordinary(unit)).tobytes()
        rest = [u for u in new if u not in self.units]
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            self.units.update(zip(some, self._by_library([u or "\n" for u in some])))
        sample = plain[:50]
        if [self.units[u] for u in sample] != self._by_library(sample):
            raise ValueError("the ranks and the tokenizer file give different ids")

    def _split(self, text: str) -> list[str]:
        if self._odd.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self._cut.split(text)
        return text.replace("\n", "\n\n").replace(" ", "\n ").split("\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit numbers, little-endian."""
        split = [self._split(t) if t else [] for t in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.units.__getitem__, units)) for units in split]


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks, pattern)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, with_ids: bool = False, ranks: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row."""

    def work(batches):
        machine = encoder(tokenizer, ranks, pattern)
        end = np.array([end_id], "<u4").tobytes()
        try:
            for part in slices(batches):
                encoded = machine.encode([t or "" for t in column_of(part, "text").to_pylist()])
                row, found, held = [], [], []
                for i, ids in enumerate(encoded):
                    ids += end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row.append(i)
                        found.append((k, start, length, zlib.crc32(own)))
                        if with_ids:
                            held.append(np.frombuffer(own, "<u4").astype(np.int32))
                values = np.array(found, np.int64).reshape(-1, 4)
                out = [column_of(part, "id").take(pa.array(row, pa.int64())), pa.array(values[:, 0].astype(np.int32))]
                out += [pa.array(np.ascontiguousarray(values[:, k])) for k in (1, 2, 3)]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)
        finally:
            machine.units.clear()  # the worker goes on with other tasks, also of other operators, beside the executor's memory

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def completion(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence, largest first) and how often each is used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = [0] * (capacity + 1)
    out: list[tuple[list[int], int]] = []
    have = np.arange(capacity + 1)
    fitting = np.maximum.accumulate(np.where(left > 0, have, 0)).tolist()
    nodes = 0

    def fill(room: int, top: int, most: int) -> tuple[int, list[int]]:
        """Least waste, and the lengths, of at most ``most`` pieces no longer than ``top``."""
        nonlocal nodes
        waste, best = room, []
        length = fitting[min(room, top)]
        while length and nodes > 0 and length * most > room - waste:
            nodes -= 1
            if used[length] < left[length]:
                rest, more = room - length, []
                if rest and most > 1:
                    used[length] += 1
                    rest, more = fill(rest, length, most - 1)
                    used[length] -= 1
                if rest < waste:
                    waste, best = rest, [length, *more]
                    if not waste:
                        break
            length = fitting[length - 1]
        return waste, best

    for largest in range(capacity, 0, -1):
        while left[largest]:
            used[largest] = 1
            waste, best = capacity - largest, []
            for most in (1, 2, 3, 4, 6, 9, capacity):
                if not waste:
                    break
                nodes = FILLINGS
                found, lengths = fill(capacity - largest, largest, most)
                if found < waste:
                    waste, best = found, lengths
            used[largest] = 0
            pattern = [largest, *best]
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            out.append((pattern, times))
            emptied = False
            for x in set(pattern):
                left[x] -= times * pattern.count(x)
                emptied |= not left[x]
            if emptied:
                fitting = np.maximum.accumulate(np.where(left > 0, have, 0)).tolist()
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: runs of ranks, sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, sequence, each, offset))
            taken[length] = first + each * times
            offset += each * length
        sequence += times
    found = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: found[:, k] for k, name in enumerate(("length", "first", "sequence", "each", "offset"))}


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with a ``length`` of 1 to ``capacity``.

    The table is written once. Repeated rows are separate pieces. An empty table stays empty.
    """
    own = written(pieces_table, "pieces")
    counts = dict(own.groupBy("length").count().collect())  # at most one row for each length up to the capacity
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = places(completion(counts, capacity))
    shift = 44
    keys = (plan["length"] << shift) + plan["first"]
    names = own.columns

    def work(batches):
        for batch in batches:
            length, rank = column_of(batch, "length").to_numpy(), column_of(batch, "rank").to_numpy()
            at = np.searchsorted(keys, (length << shift) + rank, "right") - 1
            turn, within = np.divmod(rank - plan["first"][at], plan["each"][at])
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            arrays += [pa.array(plan["sequence"][at] + turn), pa.array(plan["offset"][at] + within * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    # Ranks within a length: within a salt, plus all before it in earlier salts.
    salted = own.withColumn("salt", F.pmod(F.xxhash64(*[c for c, t in own.dtypes if not t.startswith(("array", "map"))]), F.lit(SALTS)))
    order = [c for c, t in own.dtypes if not t.startswith(("array", "map"))]
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    full = ranked.join(sizes, ["length", "salt"]).select(*names, (F.col("before") + F.col("within")).alias("rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + ", sequence_id long, offset long"
    return full.mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Null and empty texts are one piece that holds the end id only; null ids and repeated rows
    are packed like others; other columns are not read; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, **options), capacity)
