"""Removal of word passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix begins at each word that starts a window of ``size`` words; two suffixes meet at
depth ``size`` of the suffix tree if their windows are equal. Suffixes whose window has the
same smallest hash of word k-grams stand together as a run, and that k-gram is the key by
which suffixes are partitioned: equal windows always have it in common. Keys of one document
only are dropped before any text moves. Runs of equal text become one class; a class has the
smallest document of its members. Where several classes share a key, their texts are brought
together: a group that fits a task becomes a subtree (sorted suffixes and the depths at which
neighbours part), whose nodes of full depth give the repeats. A key with too many classes is
replaced by the longest prefix, the whole window, where only the smallest document counts and
is found by an aggregate. Repeats are then marked in every document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, column_of, groups, mixed, slices, span_hashes, utf8, word_spans, written
from .winnow import inside_texts, window_fingerprints

SIZE = 50
GRAM = 12
#: Suffixes of a run, and classes of a key that one task gathers.
RUN = 64
CLASSES = 1000
KEY = ["gram", "n", "hash"]


def words_of(data: np.ndarray, offsets: np.ndarray):
    return word_spans(data, offsets, ~((data == 32) | ((data >= 9) & (data <= 13))))


def runs_of(hashes: np.ndarray, first: np.ndarray, size: int, gram: int):
    """Runs of window starts in one text with the same key: text, start, count, key, hash of the run's words."""
    keys = window_fingerprints(hashes, size, gram)
    at = np.flatnonzero(inside_texts(first, size, len(keys)))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64)
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    turn = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(turn % RUN == 0)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return text[begin], start, count, keys[start], span_hashes(hashes, start, start + count + size - 1)


def _ranges(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    cut = np.flatnonzero(np.diff(values) > 1)
    return list(zip(values[np.append(0, cut + 1)].tolist(), values[np.append(cut, len(values) - 1)].tolist()))


def subtree_repeats(texts: list[bytes], docs: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each text, ranges of suffixes that also occur in a text of a smaller document.

    The suffixes, cut to ``size`` words, are sorted; neighbours that part no earlier than at
    ``size`` words hang on the same deep node, whose smallest document decides.
    """
    names: dict[bytes, int] = {}
    rows, owner, place = [], [], []
    for i, text in enumerate(texts):
        ids = np.array([names.setdefault(w, len(names) + 1) for w in text.split(b" ")], ">u4")
        windows = np.lib.stride_tricks.sliding_window_view(ids, size)
        rows.append(windows)
        owner.append(np.full(len(windows), i))
        place.append(np.arange(len(windows)))
    matrix = np.ascontiguousarray(np.concatenate(rows))
    owner, place = np.concatenate(owner), np.concatenate(place)
    order = np.argsort(matrix.view(f"S{4 * size}").ravel(), kind="stable")
    parted = matrix[order[1:]] != matrix[order[:-1]]
    depth = np.where(parted.any(axis=1), parted.argmax(axis=1), size)
    node = np.concatenate(([0], np.cumsum(depth < size)))
    least = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(np.append(True, depth < size)))
    repeated = np.zeros(len(order), bool)
    repeated[order] = least[node] < docs[owner[order]]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    hit = np.flatnonzero(repeated)
    for i in np.unique(owner[hit]).tolist():
        out[i] = _ranges(place[hit[owner[hit] == i]])
    return out


def _scan(docs: DataFrame, size: int, gram: int) -> DataFrame:
    def work(batches):
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("hash", pa.int64())]))
        for part in slices(batches):
            data, offsets = utf8(column_of(part, "text"))
            starts, ends, first = words_of(data, offsets)
            text, start, count, keys, hashes = runs_of(span_hashes(data, starts, ends), first, size, gram)
            cells = pa.StructArray.from_arrays([
                pa.array(as_long(np.ascontiguousarray(keys))), pa.array((start - first[text]).astype(np.int32)),
                pa.array(count.astype(np.int32)), pa.array(as_long(mixed(hashes ^ U64(size)))),
            ], fields=list(kind.value_type))
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(bounds), cells).cast(kind)
            yield pa.RecordBatch.from_arrays([column_of(part, "id"), column_of(part, "print"), runs], ["id", "print", "runs"])

    schema = "id long, print long, runs array<struct<gram long, at int, n int, hash long>>"
    return docs.where("id is not null").mapInArrow(work, schema)


def _texts_of(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The words of runs, taken from the document of their class."""

    def work(batches):
        for part in slices(batches, limit=1 << 20):
            texts, runs, rows = column_of(part, "text").to_pylist(), column_of(part, "runs").to_pylist(), []
            for text, own in zip(texts, runs):
                words = text.encode().split()
                for r in own:
                    rows.append((r["gram"], r["n"], r["hash"], r["id"], r["many"], b" ".join(words[r["at"] : r["at"] + r["n"] + size - 1])))
            columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["gram", "n", "hash", "id", "many", "words"])

    per_doc = wanted.groupBy("id", "print").agg(F.collect_list(F.struct("gram", "n", "hash", "id", "many", "at")).alias("runs"))
    held = docs.where("id is not null").dropDuplicates(["id", "print"])
    joined = held.join(per_doc, ["id", "print"]).select("text", "runs")
    return joined.mapInArrow(work, "gram long, n int, hash long, id long, many boolean, words binary")


def _subtrees(texts: DataFrame, size: int) -> DataFrame:
    def work(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for block in groups(batches, ["gram"], rows=4096):
            found = subtree_repeats(block.column("words").to_pylist(), block.column("id").to_numpy(), size)
            some = [i for i, r in enumerate(found) if r]
            block = block.select(KEY).take(pa.array(some, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(block.column(k).combine_chunks() for k in KEY), pa.array([found[i] for i in some], kind)], [*KEY, "ranges"])

    sorted_texts = texts.repartition("gram").sortWithinPartitions("gram")
    return sorted_texts.mapInArrow(work, "gram long, n int, hash long, ranges array<struct<first int, last int>>")


def _whole_windows(texts: DataFrame, size: int) -> DataFrame:
    """The same for keys with many classes: the prefix is the whole window, counted by an aggregate."""
    words = F.split(F.col("words").cast("string"), " ")
    each = texts.select(*KEY, "id", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    text = F.concat_ws(" ", F.slice("w", F.col("at") + 1, size))
    each = each.select(*KEY, "id", "at", F.xxhash64(text).alias("p"), F.xxhash64(F.lit(size), text).alias("q"))
    least = each.groupBy("p", "q").agg(F.min("id").alias("least"))
    found = each.join(least, ["p", "q"]).where("least < id")
    return found.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("ranges"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``id, print, spans``: the word spans (first, behind last) of each document that repeat a smaller id's window."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("print", F.xxhash64("text"))
    runs = written(_scan(source, size, gram), "runs").select("id", "print", F.inline("runs"))
    shared = runs.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("gram")
    live = written(runs.join(shared, "gram"), "runs")
    classes = live.groupBy(*KEY).agg(F.min(F.struct("id", "print", "at")).alias("f")).select(*KEY, "f.*")
    classes = written(classes, "classes")
    sizes = classes.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    wanted = classes.join(sizes, "gram").withColumn("many", F.col("c") > CLASSES).drop("c")
    texts = written(_texts_of(wanted, source, size), "suffixes")
    own = _subtrees(texts.where("not many"), size).unionByName(_whole_windows(texts.where("many"), size))
    decided = classes.select(*KEY, F.col("id").alias("least")).join(own, KEY, "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    marked = live.join(decided, KEY).withColumn("r", F.when(F.col("id") > F.col("least"), whole).otherwise(F.col("ranges")))
    spans = marked.select("id", "print", "at", F.inline("r")).select(
        "id", "print", F.struct((F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + size).alias("stop")).alias("s")
    )
    return spans.groupBy("id", "print").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM
) -> DataFrame:
    """``id_col, n_words, n_removed, kept_text`` of every row of ``docs``.

    Words covered by a window of ``size`` words that also starts in a document of a smaller id
    are removed; kept words are joined by one blank. Null and empty texts have no words. Rows
    without an id lose nothing and take nothing from others; rows of the same id count as one
    document, so repeated rows do not remove each other. Ids are integers; other columns are not
    read; an empty table gives no rows.
    """
    if not 0 < gram <= size:
        raise ValueError("grams must be no longer than windows")
    spans = written(repeats(docs, id_col, text_col, size, gram), "spans")

    def work(batches):
        for part in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, own in zip(column_of(part, "text").to_pylist(), column_of(part, "spans").to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if own:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [s["start"] for s in own], 1)
                    np.add.at(cover, [s["stop"] for s in own], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept_text"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = source.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = source.join(spans, (source["id"].cast("long") == spans["id"]) & (source["print"] == spans["print"]), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.select(source["id"], "text", "spans").mapInArrow(work, f"id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
