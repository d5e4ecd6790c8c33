"""Benchmark decontamination by winnowing.

Every window of ``size`` words keeps the smallest hash of its word k-grams as its
fingerprint, so equal windows have equal fingerprints and no shared span of a window's
length is missed. Benchmark fingerprints mark a bitmap of fixed size; windows of documents
whose fingerprint is marked are joined with the benchmark's on the fingerprint, and a hit
is extended to the words of the whole window, which must be equal. An item of fewer words
than a window is one window, with the hash of all its words as fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, column_of, slices, span_hashes, utf8, window_hashes, word_spans, written

SIZE = 13
GRAM = 8
#: Bits of the bitmap, as a power of two: 1 MB whatever the benchmark.
BITS = 23


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Spans of words, whose bytes are 0-9, a-z or part of a non-ASCII character."""
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    return word_spans(data, offsets, inside)


def window_fingerprints(hashes: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The smallest k-gram hash of each run of ``size`` word hashes."""
    if gram >= size:
        return window_hashes(hashes, size)
    grams = window_hashes(hashes, gram)
    count = max(0, len(hashes) - size + 1)
    least = grams[:count].copy()
    for k in range(1, size - gram + 1):
        np.minimum(least, grams[k : k + count], out=least)
    return least


def inside_texts(first: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of the ``count`` window starts have their whole window in one text."""
    ok = np.zeros(count, bool)
    ends = first[1:] - size + 1
    for a, b in zip(first[:-1][ends > first[:-1]].tolist(), ends[ends > first[:-1]].tolist()):
        ok[a:b] = True
    return ok


def _hashed(part: pa.RecordBatch):
    data, offsets = utf8(column_of(part, "text"))
    data = lowered(data)
    starts, ends, first = words_of(data, offsets)
    return data, starts, ends, first, span_hashes(data, starts, ends)


def _window_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> str:
    held = data[starts[at] : ends[at + size - 1]].tobytes()
    base = starts[at]
    return b" ".join([held[s - base : e - base] for s, e in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist())]).decode()


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``fingerprint, n, window, items``: every different window and the items that have it."""

    def work(batches):
        for part in slices(batches):
            data, starts, ends, first, hashes = _hashed(part)
            ids, rows = column_of(part, "id").to_pylist(), []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if a == b:
                    continue
                n = min(size, b - a)
                prints = as_long(window_fingerprints(hashes[a:b], n, gram if n == size else n)).tolist()
                rows += [(ids[i], p, n, _window_text(data, starts, ends, a + k, n)) for k, p in enumerate(prints)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (column_of(part, "id").type, pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item", "fingerprint", "n", "window"])

    kind = items.schema[item_col].dataType.simpleString()
    source = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(work, f"item {kind}, fingerprint long, n int, window string")
    return rows.groupBy("fingerprint", "n", "window").agg(F.collect_set("item").alias("items"))


def bitmap(prints: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of fixed size in which every ``fingerprint`` of the table is marked."""
    slot = F.shiftrightunsigned("fingerprint", 64 - bits)
    words = prints.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fingerprint, {64 - bits}) & 63 as int))")).alias("marks")
    )
    out = np.zeros(1 << bits - 6, np.int64)
    for word, marks in words.collect():  # at most 2 ** (bits - 6) rows whatever the benchmark
        out[word] = marks
    return out.view(U64)


def marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints >> U64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[slot >> U64(6)] >> (slot & U64(63))) & U64(1) == 1


def suspects(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, size: int, gram: int) -> DataFrame:
    """Every row's words and its windows with a marked fingerprint, as one written table."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows))  # 1 MB, fixed
    short = sorted(r[0] for r in windows.where(F.col("n") < size).select("n").distinct().collect())  # fewer than size

    def work(batches):
        bits = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("fingerprint", pa.int64()), ("window", pa.string())]))
        for part in slices(batches):
            data, starts, ends, first, hashes = _hashed(part)
            found: list[list] = [[] for _ in range(part.num_rows)]
            for n in (*short, size):
                prints = window_fingerprints(hashes, n, gram if n == size else n)
                at = np.flatnonzero(marked(bits, prints) & inside_texts(first, n, len(prints)))
                text = np.searchsorted(first, at, "right") - 1
                for a, i, p in zip(at.tolist(), text.tolist(), as_long(prints[at]).tolist()):
                    found[i].append((a - int(first[i]), n, p, _window_text(data, starts, ends, a, n)))
            arrays = [column_of(part, "row"), column_of(part, "id"), pa.array(np.diff(first)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "n_words", "windows"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"row long, id {kind}, n_words long, windows array<struct<start int, n int, fingerprint long, window string>>"
    return written(source.mapInArrow(work, schema), "windows")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = SIZE, gram: int = GRAM,
) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items, contaminated`` of every row of ``docs``.

    ``n_hit`` words lie inside an occurrence of a benchmark window, ``items`` are the ids of
    items with occurring windows, and at least a twentieth of the words hit is contamination.
    Null and empty texts have no words and are clean; repeated rows and null ids are kept;
    items without words have no windows; items with a null id count as hits without an id;
    other columns are not read; an empty table gives no rows.
    """
    if not 0 < gram <= size:
        raise ValueError("grams must be no longer than windows")
    windows = written(benchmark_windows(items, item_col, item_text_col, size, gram), "benchmark")
    rows = suspects(docs, windows, id_col, text_col, size, gram)
    hits = rows.select("row", F.inline("windows")).join(windows, ["fingerprint", "n", "window"])
    spans = hits.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    state = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s.upto, x.stop).alias("upto"), (s.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, s.upto))).alias("n")
        ),
    )
    counted = spans.select("row", state.n.alias("n_hit"), "items")
    out = rows.select("row", "id", "n_words").join(counted, "row", "left")
    kind = items.schema[item_col].dataType.simpleString()
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; a verdict depends on the text alone, which md5 names here."""
    named = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("name"), F.col(text_col).alias("text"))
    found = contamination(named, items, "name", "text", item_col, item_text_col).where("contaminated").select("name").distinct()
    bad = written(found.withColumnRenamed("name", "__name"), "contaminated")
    return docs.join(bad, F.md5(F.coalesce(docs[text_col], F.lit(""))) == F.col("__name"), "left_anti")
