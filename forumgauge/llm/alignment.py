"""Token alignment of two tokenizers, and how firmly pairs of their tokens belong together in the corpus.

Both tokenizers cut the same bytes, so their tokens meet where a token of each ends. The two arrays of
ends are followed by diagonal run skipping: as long as tokens agree one to one, index i of one array meets
index i + shift of the other, and exponential probing at the current shift finds how far that goes in
a few comparisons of stretches. Where the ends part, the irregular group is resolved locally, token
by token, and the shift changes by the difference of its sizes.

A pair of tokens is linked if their groups are the same. Pairs are counted by documents over the whole
corpus. The counts go back to the documents in two ways: a table of the most frequent pairs, bounded by
``PAIRS``, is broadcast, so that most links are scored where their document is; all rarer pairs are joined
by a shuffle, in which no key is frequent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, written

#: Pairs of the broadcast table at most.
PAIRS = 1 << 18
#: Units that a worker remembers at most; half of them are given up at a time, unless they were used since.
UNITS = 600_000
#: New units that are aligned at once, and how many of them are encoded as one text.
LOT, TOGETHER = 20_000, 64
#: Links of a group that are listed one by one; those of larger groups are counted by their different tokens.
LISTED = 1 << 14
_coders: dict[tuple[str, str], Coders] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Known:
    """What was found for units, by number: the groups' names, and in arrays the figures and the links of all behind each other."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        #: Tokens of A and B, and groups; -1 for a unit whose bytes a tokenizer does not give back.
        self.figures = np.zeros((0, 3), np.int32)
        self.ends, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, units: list[str], names: list[str], figures: np.ndarray, ends: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.names), len(self.names) + len(units))))
        self.names += names
        self.figures = np.concatenate((self.figures, figures.astype(np.int32)))
        self.ends = np.concatenate((self.ends, ends + self.ends[-1]))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))

    def links(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and times of the chosen units in their order, and where each unit's end."""
        first = self.ends[chosen]
        size = self.ends[chosen + 1] - first
        upto = np.cumsum(size)
        place = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - upto + size, size)
        return self.pairs[place], self.times[place], upto

    def take(self, other: Known, units: list[str]) -> None:
        """Add what another one has of these units."""
        chosen = np.array([other.number[u] for u in units], np.int64)
        pairs, times, ends = other.links(chosen)
        self.add(units, [other.names[i] for i in chosen.tolist()], other.figures[chosen], ends, pairs, times)


class Coders:
    """Two tokenizers: a byte-level BPE file of the tokenizers library (A) and a sentencepiece model (B) that marks blanks.

    Neither joins a visible character with a blank behind it, so a text is the sum of its units (a blank
    and what follows up to the next single blank), and a group never crosses from one to the next. Units met for the first time
    are aligned, many behind each other; what was found is remembered. For the same reason many units are encoded as one text, which
    spares most of what a call costs; if its bytes do not come back, its units are encoded in smaller lots, and in the end alone.
    """

    _cut = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters, entries = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on beyond a blank, so texts can not be cut into units")
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.a_names, self.b_names = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.known, self.older = Known(), Known()

    def whole(self, a: list[int], b: list[int], text: str) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw

    def _encoded(self, new: list[str], together: int) -> tuple[list[str], list[int], list[int], list[str]]:
        """Units whose bytes both give back, in some order, the ids of A and of B for all of them, and the other units."""
        inner = [u for u in new if not (u[1:2].isspace() or u[-1].isspace())]  # these can stand behind each other
        lots = [inner[at : at + together] for at in range(0, len(inner), together)] + [[u] for u in new if u[1:2].isspace() or u[-1].isspace()]
        order, ids_a, ids_b, failed = [], [], [], []
        while lots:
            joined, again = ["".join(lot) for lot in lots], []
            first = self.a.encode_batch_fast(joined, add_special_tokens=False)
            second = self.b.encode([j[1:] for j in joined], num_threads=1)
            for lot, text, a, b in zip(lots, joined, (e.ids for e in first), second):
                if self.whole(a, b, text):
                    order += lot
                    ids_a += a
                    ids_b += b
                elif len(lot) == 1:
                    failed += lot
                else:
                    size = max(1, len(lot) // 8)
                    again += [lot[at : at + size] for at in range(0, len(lot), size)]
            lots = again
        return order, ids_a, ids_b, failed

    def _learn(self, new: list[str], together: int | None = None) -> None:
        """Encode units and align them together, as one pair of long arrays of ends; a unit begins and ends with a group."""
        order, ids_a, ids_b, failed = self._encoded(new, together or TOGETHER)
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends = np.cumsum([len(u.encode()) for u in order], dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        if (ends_a[last_a] != ends).any() or (ends_b[last_b] != ends).any():  # a token goes on beyond its unit
            if together == 1:
                raise ValueError("tokens of a unit do not end with it")
            return self._learn(new, 1)
        upto_a, upto_b = meet(ends_a.tolist(), ends_b.tolist())
        names = _named(self, ids_a, ids_b, upto_a, upto_b)
        upto_a, upto_b = np.array(upto_a, np.int64), np.array(upto_b, np.int64)
        pairs, times, upto_link = linked(ids_a, ids_b, upto_a, upto_b)
        last = np.searchsorted(upto_a, last_a + 1) + 1  # behind a unit's last group
        figures = np.diff(np.stack([last_a + 1, last_b + 1, last], axis=1), axis=0, prepend=np.zeros((1, 3), np.int64))
        cuts = [0, *last.tolist()]
        self.known.add(order, [";".join(names[i:j]) for i, j in zip(cuts, cuts[1:])], figures, np.concatenate(([0], upto_link))[last], pairs, times)
        none = np.zeros(0, np.int64)
        self.known.add(failed, [""] * len(failed), np.full((len(failed), 3), -1), np.zeros(len(failed), np.int64), none, none)

    def aligned(self, texts: list[str]) -> Iterator[tuple | None]:
        """For each text behind a blank ``n_a, n_b, n_groups``, the names of its groups by unit, and its links with their times.

        None for an empty text, or one whose bytes either tokenizer does not give back.
        """
        split = [self._cut.split(" " + t) if t else [] for t in texts]
        needed = set().union(*split)
        if len(self.known.names) + len(needed) > UNITS // 2:
            self.known, self.older = Known(), self.known  # units in use come back from the older half
        known = self.known.number
        new = [u for u in needed if u not in known]
        self.known.take(self.older, [u for u in new if u in self.older.number])
        new = [u for u in new if u not in known]
        for at in range(0, len(new), LOT):
            self._learn(new[at : at + LOT])
        names = self.known.names
        for units in split:
            chosen = [known[u] for u in units]
            at = np.array(chosen, np.int64)
            figures = self.known.figures[at]
            if not units or (figures[:, 0] < 0).any():
                yield None
            else:
                yield *figures.sum(axis=0, dtype=np.int64).tolist(), [names[i] for i in chosen], *self.known.links(at)[:2]


def coders(byte_path: str, piece_path: str) -> Coders:
    if (byte_path, piece_path) not in _coders:
        _coders[byte_path, piece_path] = Coders(byte_path, piece_path)
    return _coders[byte_path, piece_path]


def agreeing(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends agree one to one from ``a[i]`` and ``b[j]`` on, by exponential probing and bisection."""
    most = min(len(a) - i, len(b) - j)
    if not most or a[i] != b[j]:
        return 0
    have = 1
    while have < most:
        reach = min(2 * have, most)
        if a[i + have : i + reach] != b[j + have : j + reach]:
            break
        have = reach
    else:
        return have
    while reach - have > 1:  # the first ``have`` agree, the first ``reach`` do not
        half = (have + reach) // 2
        if a[i + have : i + half] == b[j + have : j + half]:
            have = half
        else:
            reach = half
    return have


def meet(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each group, the numbers of tokens of both up to its end. Both arrays of ends must end alike."""
    upto_a, upto_b = [], []
    i = shift = 0
    n = len(a)
    while i < n:
        run = agreeing(a, b, i, i + shift)
        if run:
            upto_a += range(i + 1, i + run + 1)
            upto_b += range(i + shift + 1, i + shift + run + 1)
            i += run
            if i == n:
                break
        j = i + shift
        while a[i] != b[j]:
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i += 1
        shift = j + 1 - i
        upto_a.append(i)
        upto_b.append(i + shift)
    return upto_a, upto_b


def linked(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (as a * 2^32 + b) in the order of groups, how often each is linked, and where each group's end.

    The links of a group stand one by one; a group with very many has its different pairs, with their numbers.
    """
    start_a, start_b = np.append(0, upto_a[:-1]).astype(np.int64), np.append(0, upto_b[:-1]).astype(np.int64)
    n_b, size = upto_b - start_b, (upto_a - start_a) * (upto_b - start_b)
    listed = np.where(size <= LISTED, size, 0)
    group = np.repeat(np.arange(len(size)), listed)
    turn = np.arange(len(group)) - np.repeat(np.cumsum(listed) - listed, listed)
    pairs = (ids_a[start_a[group] + turn // n_b[group]].astype(np.int64) << 32) + ids_b[start_b[group] + turn % n_b[group]]
    times = np.ones(len(group), np.int64)
    large = np.flatnonzero(size > LISTED)
    if not len(large):
        return pairs, times, np.cumsum(size)
    at, more_pairs, more_times, count = np.cumsum(listed), [], [], listed.copy()
    for g in large.tolist():
        a, many_a = np.unique(ids_a[start_a[g] : upto_a[g]], return_counts=True)
        b, many_b = np.unique(ids_b[start_b[g] : upto_b[g]], return_counts=True)
        more_pairs.append(((a.astype(np.int64) << 32)[:, None] + b).ravel())
        more_times.append((many_a[:, None] * many_b).ravel())
        count[g] = len(more_pairs[-1])
    place = np.repeat(at[large], count[large])
    return np.insert(pairs, place, np.concatenate(more_pairs)), np.insert(times, place, np.concatenate(more_times)), np.cumsum(count)


def _named(machine: Coders, ids_a: np.ndarray, ids_b: np.ndarray, upto_a: list[int], upto_b: list[int]) -> list[str]:
    """Each group as ``a1,a2|b1,b2``."""
    a, b = [machine.a_names[i] for i in ids_a.tolist()], [machine.b_names[i] for i in ids_b.tolist()]
    out, i, j = [], 0, 0
    for p, q in zip(upto_a, upto_b):
        out.append(f"{a[i]}|{b[j]}" if p - i == q - j == 1 else f"{','.join(a[i:p])}|{','.join(b[j:q])}")
        i, j = p, q
    return out


def aligned(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, links: bool = True,
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups`` of every row, and with ``links`` its different pairs ``a, b`` and their ``times``.

    ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is the SHA-256 of that. Null and empty
    texts, and texts whose bytes a tokenizer does not give back, have no tokens and empty ``groups``, which are not hashed.
    """

    def work(batches):
        machine = coders(byte_path, piece_path)
        for part in slices(batches, limit=1 << 20):
            rows, a, b, times, ends = [], [], [], [], [0]
            for found in machine.aligned([t or "" for t in column_of(part, "text").to_pylist()]):
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    ends.append(ends[-1])
                    continue
                n_a, n_b, n_groups, names, pairs, many = found
                names = ";".join(names)
                names = hashlib.sha256(names.encode()).hexdigest() if digest else names
                rows.append((n_a, n_b, n_groups, int(many.sum()), names))
                if links:
                    pairs, place = np.unique(pairs, return_inverse=True)
                    a.append((pairs >> 32).astype(np.int32))
                    b.append((pairs & 0xFFFFFFFF).astype(np.int32))
                    times.append(np.bincount(place, many, len(pairs)).astype(np.int64))
                ends.append(ends[-1] + len(pairs) * links)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])]
            columns.insert(0, column_of(part, "id"))
            if links:
                for c, kind in ((a, np.int32), (b, np.int32), (times, np.int64)):
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(c) if c else np.zeros(0, kind))))
            yield pa.RecordBatch.from_arrays(columns, names_out)

    names_out = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", *["a", "b", "times"] * links]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string" + ", a array<int>, b array<int>, times array<long>" * links
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return found.withColumnRenamed("id", id_col)


def pair_counts(cells: DataFrame) -> DataFrame:
    """``a, b, count, best``: rows that link the pair, and whether no pair of ``a`` has more."""
    counts = written(cells.groupBy("a", "b").agg(F.count("*").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are counted that often."""
    by_size = pairs.groupBy(F.floor(F.log2("count")).alias("s")).count().collect()  # at most 62 rows
    left, level = 0, 62
    for s, n in sorted(by_size, reverse=True):
        if left + n > most:
            break
        left, level = left + n, s
    return 1 << level


def alignment_scores(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` of every row of ``docs``.

    ``groups`` as in :func:`aligned`. A pair's count is the number of rows that link it; ``n_best`` are the row's links
    whose count is the highest of their token of A (ties included), ``count_sum`` the sum of the counts over its links. Every row is a document,
    so repeated rows count as often as they occur, whatever their ids; null ids are kept. Rows without tokens have zeros. Other
    columns are not read. An empty table gives no rows.
    """
    rows = aligned(docs, byte_path, piece_path, id_col, text_col, digest).withColumnRenamed(id_col, "id")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")  # numbered once, in the written table
    cells = rows.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    pairs = written(pair_counts(cells.select("a", "b")), "pairs")
    level = frequent(pairs, PAIRS)
    known, rest = F.broadcast(pairs.where(F.col("count") >= level)), pairs.where(F.col("count") < level)
    summed = lambda df: df.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    parts = summed(cells.join(known, ["a", "b"]))
    if not rest.isEmpty():
        rare = cells.join(known.select("a", "b"), ["a", "b"], "left_anti")
        parts = parts.unionByName(summed(rare.join(rest, ["a", "b"])))
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    scored = rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups").join(parts, "row", "left")
    return scored.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
