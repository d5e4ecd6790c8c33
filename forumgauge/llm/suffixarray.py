"""Removal of byte strings that repeat anywhere, by suffix arrays built by linear grouping.

A string of ``size`` bytes repeats if two suffixes of the corpus share that many bytes, so they stand
next to each other in a suffix array. Suffixes are dealt out to many small arrays: the key of a suffix
is the byte gram with the least hash among its first ``size`` bytes, which equal strings have in
common. Neighbouring suffixes of a text mostly have the same key and travel as one cell, the text from
the first of them to the end of the last. Keys that occur once are dropped before any text moves, and
equal cells are one class.

Each remaining key is a small text of its own (what its classes share with each other, one behind the
other), whose suffix array is built by grouping: suffixes that begin with the same Lyndon word form a group; groups are taken in descending
order, and each lengthens the words of the suffixes its members point back to (the previous smaller
ones), which splits their groups; then the groups are read once in ascending order, and each suffix
puts those that point to it in their places. No names are given and no text is sorted again.

A key of too many classes is split by more bytes: a window reaches at least half of the free bytes
further to the left or to the right than the gram, which makes two longer keys, and each of them two again; after five such rounds
a key is a whole window. No window is dropped, and each has one key throughout.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, column_of, groups, slices, utf8, window_hashes, written

SIZE = 400
GRAM = 64
#: Classes of a key that one task puts into one suffix array.
CLASSES = 1024
#: Window starts a scan holds at once, and the bits that number them.
STEP, PLACE_BITS = 1 << 21, 22
CLASS = ["key", "d1", "d2"]


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order. The last symbol must be the only smallest one."""
    n = len(symbols)
    members: list[list[int]] = [[] for _ in range(max(symbols) + 1)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    members = [m for m in members if m]
    group, size = [0] * n, [len(m) for m in members]
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    smaller, done = [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:  # descending: a group's Lyndon words are final when its turn comes
        parents, copies, last = [], [], -1
        own = members[g]
        for i in own:
            if group[i] != g:  # it has moved to a higher group since
                continue
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            if p >= 0 and group[p] == g:  # the same word again, directly before
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                if p == last:
                    copies[-1] += 1
                else:
                    parents.append(p)
                    copies.append(1)
                    last = p
        for i in own:
            if group[i] == g:
                done[i] = 1
        members[g] = ()
        # a suffix followed by more copies of the word is the greater one, and any is greater than one with none
        split: dict[int, dict[int, int]] = {}
        if len(parents) > 1 and max(copies) > 1:
            turn = sorted(range(len(parents)), key=lambda x: -copies[x])
            parents, copies = [parents[x] for x in turn], [copies[x] for x in turn]
        for p, k in zip(parents, copies):
            old = group[p]
            if size[old] == 1 and old not in split:
                continue  # alone in its group: the order does not change
            to = split.setdefault(old, {})
            if k not in to:
                new = to[k] = len(members)
                members.append([])
                size.append(0)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
            new = to[k]
            size[old] -= 1
            size[new] += 1
            group[p] = new
            members[new].append(p)
        g = below[g]
    first, at, g = [0] * len(members), 0, 0
    while g >= 0:
        first[g] = at
        at += size[g]
        g = above[g]
    order, placed = [n - 1] * n, bytearray(n)
    placed[n - 1] = 1
    first[group[n - 1]] += 1
    for x in range(n):  # ascending: what ends its word where this suffix begins comes next in its group
        p = order[x] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[first[g]] = p
            first[g] += 1
            placed[p] = 1
            p = smaller[p]
    return order


def repeated_starts(texts: list[bytes], copies: list[int], size: int) -> list[list[tuple[int, int]]]:
    """For each text, the runs (first, last) of starts whose ``size`` bytes occur more than once, counting copies of a text."""
    many, joined = len(texts), b"\0".join(texts) + b"\0"
    symbols = [b + many for b in joined]
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in texts)]
    for i, e in enumerate(ends):
        symbols[e] = many - 1 - i  # each end differs, and the last is the least
    whole = np.zeros(len(joined), bool)
    seen = np.zeros(len(joined), bool)
    for t, e, c in zip(texts, ends, copies):
        whole[e - len(t) : e - size + 1] = True
        seen[e - len(t) : e - size + 1] = c > 1
    order = np.array(suffix_order(symbols))
    left, right = order[:-1], order[1:]
    near = np.flatnonzero(whole[left] & whole[right])
    data = np.frombuffer(joined, np.uint8)
    half = np.flatnonzero(data[left[near] + size // 2] == data[right[near] + size // 2])  # most neighbours differ there or not at all
    for a, b in zip(left[near[half]].tolist(), right[near[half]].tolist()):
        if joined[a : a + size] == joined[b : b + size]:
            seen[a] = seen[b] = True
    out = []
    for t, e in zip(texts, ends):
        edges = np.diff(np.concatenate(([0], seen[e - len(t) : e].view(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist())))
    return out


def _alike(a: bytes, b: bytes) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def reaches(contexts: list[bytes]) -> list[int]:
    """For each string, the longest beginning it shares with another one: its neighbours in order have it."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    out = [0] * len(contexts)
    for i, j in zip(order, order[1:]):
        n = _alike(contexts[i], contexts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated_in_key(pieces: list[bytes], low: list[int], copies: list[int], size: int) -> list[list[tuple[int, int]]]:
    """The runs of repeated starts of the pieces of a key, which have the same gram at ``low``.

    Equal windows have the gram in the same place, so only what a piece shares with another one, to the left
    and to the right of it, can repeat. The rest is cut off, and pieces that are now equal are one text of the array.
    """
    left = reaches([p[:a][::-1] for p, a in zip(pieces, low)])
    right = reaches([p[a:] for p, a in zip(pieces, low)])
    begin = [a - x for a, x in zip(low, left)]
    texts: dict[bytes, int] = {}
    cut = [p[b : a + y] for p, a, b, y in zip(pieces, low, begin, right)]
    for c in cut:
        if len(c) >= size:
            texts[c] = texts.get(c, 0) + 1
    found = {}
    if len(texts) == 1:  # all that is left is equal
        found = {t: [(0, len(t) - size)] if n > 1 else [] for t, n in texts.items()}
    elif texts:
        found = dict(zip(texts, repeated_starts(list(texts), list(texts.values()), size)))
    out = []
    for piece, c, b, n in zip(pieces, cut, begin, copies):
        out.append([(0, len(piece) - size)] if n > 1 else [(x + b, y + b) for x, y in found.get(c, ())])
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(data: np.ndarray, valid: np.ndarray, size: int, gram: int):
    """Runs of window starts with the same least gram: first and last start, place of the gram, and its hash."""
    hashes = window_hashes(data, gram)
    mask = U64((1 << PLACE_BITS) - 1)
    ranked = (hashes & ~mask) | (mask - np.arange(len(hashes)).astype(U64))  # of equal ones the last
    at = np.flatnonzero(valid)
    place = (mask - (window_minima(ranked, size - gram + 1)[at] & mask)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return at[begin], at[last], place[begin], hashes[place[begin]]


def _digests(pieces: list[bytes]) -> np.ndarray:
    """Two numbers of 64 bits for each piece, together its cryptographic digest."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in pieces]), np.int64).reshape(-1, 2)


def _cells(source: DataFrame, size: int, gram: int) -> DataFrame:
    """``id, print, cells`` of every row with at least one window."""

    def work(batches):
        for part in slices(batches, limit=STEP // 4):  # a worker holds some dozen numbers for each byte, and keeps its tables of powers
            data, offsets = utf8(column_of(part, "text"))
            columns = []
            ends = np.repeat(offsets[1:], np.diff(offsets))
            for low in range(0, len(data), STEP):
                some = data[low : low + STEP + size - 1]
                if len(some) < size:
                    break
                starts = np.arange(low, low + len(some) - size + 1)
                first, last, place, key = anchors(some, starts + size <= ends[starts], size, gram)
                raw = some.tobytes()
                digest = _digests([raw[a : b + size] for a, b in zip(first.tolist(), last.tolist())])
                columns.append((first + low, last + low, place - first, as_long(key), digest[:, 0], digest[:, 1]))
            if not columns:
                continue
            first, last, at, key, d1, d2 = (np.concatenate(c) for c in zip(*columns))
            text = np.searchsorted(offsets, first, "right") - 1
            own = [first - offsets[text], last - offsets[text], at, key, d1, d2]
            cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in own], ["first", "last", "at", "key", "d1", "d2"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)), cells)
            found = pa.RecordBatch.from_arrays([column_of(part, "id"), column_of(part, "print"), listed], ["id", "print", "cells"])
            yield found.filter(pa.array(np.diff(listed.offsets.to_numpy()) > 0))

    kind = source.schema["id"].dataType.simpleString()
    cell = "struct<first:long,last:long,at:long,key:long,d1:long,d2:long>"
    return source.mapInArrow(work, f"id {kind}, print binary, cells array<{cell}>")


def _pieces(source: DataFrame, wanted: DataFrame, size: int, gram: int) -> DataFrame:
    """The texts of classes: ``key, d1, d2, n, low, high, piece``; ``low`` to ``high`` is what all classes of the key have in common."""

    def work(batches):
        for part in slices(batches):
            out = []
            for text, own in zip(column_of(part, "text").to_pylist(), column_of(part, "own").to_pylist()):
                raw = text.encode()
                out += [(c["key"], c["d1"], c["d2"], c["n"], c["at"], c["at"] + gram, raw[c["first"] : c["last"] + size]) for c in own]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [*CLASS, "n", "low", "high", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    per = wanted.groupBy("print", F.col("id").alias("own_id")).agg(F.collect_list(F.struct(*CLASS, "n", "first", "last", "at")).alias("own"))
    per = per.withColumnRenamed("print", "own_print")
    texts = source.join(per, (F.col("print") == F.col("own_print")) & F.col("id").eqNullSafe(F.col("own_id")))
    found = texts.select("text", "own").mapInArrow(work, "key long, d1 long, d2 long, n long, low long, high long, piece binary")
    return found.dropDuplicates(CLASS)  # rows of the same id and text


def _by_array(classes: DataFrame, size: int) -> DataFrame:
    """``key, d1, d2, ranges`` from one suffix array for each key."""

    def work(batches):
        for block in groups(batches, ["key"], 2048):
            key = block.column("key").to_numpy()
            pieces, low, n = (block.column(c).to_pylist() for c in ("piece", "low", "n"))
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
            found = [r for a, b in zip(cut, cut[1:]) for r in repeated_in_key(pieces[a:b], low[a:b], n[a:b], size)]
            ranges = pa.array([[{"first": a, "last": b} for a, b in r] for r in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            out = pa.Table.from_arrays([*(block.column(c) for c in CLASS), ranges], [*CLASS, "ranges"])
            yield from out.filter(pa.array([bool(r) for r in found])).to_batches()

    dealt = classes.select(*CLASS, "n", "low", "piece").repartition("key").sortWithinPartitions(*CLASS)
    return dealt.mapInArrow(work, "key long, d1 long, d2 long, ranges array<struct<first:long,last:long>>")


def halves(piece: bytes, low: int, high: int, size: int) -> list[tuple[int, int, int, int, bytes]]:
    """The starts of a piece in two parts, each with a longer common stretch: ``side, shift, low, high, piece``."""
    free = size - (high - low)
    reach = (free + 1) // 2
    out, last = [], len(piece) - size
    if low >= reach:
        out.append((0, 0, low - reach, high, piece[: min(last, low - reach) + size]))
    begin = max(0, low - reach + 1)
    if begin <= last:
        out.append((1, begin, low - begin, high - begin + free - reach + 1, piece[begin:]))
    return out


def quarters(piece: bytes, low: int, high: int, size: int) -> list[tuple[int, int, int, int, bytes]]:
    """Halves of the halves, as :func:`halves` gives them."""
    return [
        (2 * side + again, shift + more, a, b, part)
        for side, shift, low, high, half in halves(piece, low, high, size) for again, more, a, b, part in halves(half, low, high, size)
    ]


def _split(classes: DataFrame, size: int) -> DataFrame:
    """The quarters of each class: its class (``up_*``), ``shift``, and the class, count and text of the quarter."""

    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for side, shift, low, high, piece in quarters(r["piece"], r["low"], r["high"], size):
                    name = blake2b(bytes([side]) + piece[low:high], digest_size=8).digest()
                    rows.append((r["key"], r["d1"], r["d2"], r["n"], shift, low, high, int(np.frombuffer(name, np.int64)[0]), piece))
            columns = list(zip(*rows)) if rows else [()] * 9
            digest = _digests([low.to_bytes(8, "big") + piece for low, piece in zip(columns[5], columns[8])])  # a periodic piece can have its stretch in two places
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.binary()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(arrays, ["up_key", "up_d1", "up_d2", "n", "shift", "low", "high", "key", "piece", "d1", "d2"])

    return classes.select(*CLASS, "n", "low", "high", "piece").mapInArrow(
        work, "up_key long, up_d1 long, up_d2 long, n long, shift long, low long, high long, key long, piece binary, d1 long, d2 long")


def decided(classes: DataFrame, size: int) -> DataFrame:
    """``key, d1, d2, ranges``: the starts of each class, from 0, whose window occurs more than once."""
    sizes = written(classes.groupBy("key").agg(F.count("*").alias("many")), "sizes")  # read back, so that a hot key of the join can be split
    known = written(classes.join(sizes, "key"), "classes")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.octet_length("piece") - size).cast("long").alias("last")))
    alone = known.where("many = 1 AND n > 1").select(*CLASS, whole.alias("ranges"))
    found = alone.unionByName(_by_array(known.where((F.col("many") > 1) & (F.col("many") <= CLASSES)), size))
    rest = known.where(F.col("many") > CLASSES)
    if rest.isEmpty():
        return found
    split = written(_split(rest, size), "quarters")
    below = split.groupBy(*CLASS).agg(F.sum("n").alias("n"), F.first(F.struct("low", "high", "piece")).alias("c")).select(*CLASS, "n", "c.*")
    inner = split.select("up_key", "up_d1", "up_d2", "shift", *CLASS).join(decided(below, size), CLASS)
    moved = F.transform("ranges", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last")))
    upper = inner.groupBy("up_key", "up_d1", "up_d2").agg(F.flatten(F.collect_list(moved)).alias("ranges"))
    return found.unionByName(upper.toDF(*CLASS, "ranges"))


def repeated_spans(source: DataFrame, size: int, gram: int) -> DataFrame:
    """``print, spans``: for each different text of ``source`` (id, text, print), the runs of starts that repeat, first and last."""
    each = written(_cells(source, size, gram), "cells")
    texts = written(each.groupBy("print").agg(F.count("*").alias("m"), F.min("id").alias("id"), F.first("cells").alias("cells")), "cells")
    cells = texts.select("print", "m", "id", F.inline("cells"))
    same = lambda c: F.min(c) == F.max(c)
    shared = cells.groupBy("key").agg(F.sum("m").alias("total"), (same("d1") & same("d2")).alias("one")).where("total > 1").select("key", "one")
    shared = written(shared, "shared")  # read back, so that a hot key of the join can be split
    live = written(cells.join(shared, "key"), "live")
    wanted = live.where("NOT one").groupBy(*CLASS).agg(F.sum("m").alias("n"), F.min(F.struct("print", "id", "first", "last", "at")).alias("f"))
    pieces = written(_pieces(source, wanted.select(*CLASS, "n", "f.*"), size, gram), "pieces")
    found = live.where("NOT one").select("print", F.col("first").alias("begin"), *CLASS).join(decided(pieces, size), CLASS)
    partial = found.select("print", "begin", F.inline("ranges")).select("print", F.col("begin") + F.col("first"), F.col("begin") + F.col("last"))
    spans = live.where("one").select("print", "first", "last").union(partial)
    return spans.groupBy("print").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept`` (binary) of every row of ``docs``.

    Each byte of a text, as UTF-8, that lies in a string of ``size`` bytes which also starts anywhere else, in the same text
    or another, is removed; strings are judged on the input and never cross texts; ``n_spans`` counts maximal removed runs.
    All copies go, the first as well. A row is a document, so repeated rows remove each other, and ids, null or not, do not
    matter. Null texts are empty ones. Characters may be cut apart. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < gram <= size:
        raise ValueError("grams must be no longer than windows")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("print", F.unhex(F.md5(F.col("text").cast("binary"))))
    spans = written(repeated_spans(source, size, gram), "spans").withColumnRenamed("print", "own_print")

    def work(batches):
        for part in slices(batches):
            rows = []
            for text, own in zip(column_of(part, "text").to_pylist(), column_of(part, "spans").to_pylist()):
                raw = text.encode()
                cover = np.zeros(len(raw) + 1, np.int32)
                if own:
                    np.add.at(cover, [s["first"] for s in own], 1)
                    np.add.at(cover, [s["last"] + size for s in own], -1)
                gone = np.cumsum(cover)[:-1] > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) and gone[0])
                kept = raw if not runs else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), len(raw) - len(kept), runs, kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([column_of(part, "id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = source.join(spans, F.col("print") == F.col("own_print"), "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(work, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
