"""Token counts by a compiled finite-state transducer.

A BPE vocabulary is compiled, state by state as texts need it, into a deterministic
transducer over characters. After a prefix of a text, the encoding of that prefix is
its last piece plus the encoding of what comes before, so a state holds, for every open
suffix that can still grow into a piece, the piece before it and how many tokens lie
between; a transition carries the change of the token count. White space after a word
and characters outside the vocabulary return to a fixed state.

Texts are cut into chunks. All chunks of a slice are walked in lockstep, each from its
first returning character on, which gives its exit state and count whatever came before:
its state map is constant behind its head. A scan over the chunks then hands exit states
on as entry states and walks the heads. The pieces and scores come from the library's
model; counts equal the library's.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices

SPACE = "▁"
#: Characters of a chunk, and cells of the transition table before it is compiled anew.
CHUNK = 1024
CELLS = 32_000_000
_compiled: dict[str, Transducer] = {}


class Transducer:
    """A lazily compiled transducer of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        usual = [i for i in range(library.vocab_size()) if not (
            library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)
        )]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in usual}
        self.opens = {p[:k] for p in self.score for k in range(1, len(p))}
        probe = "ﬁ  x½ "
        if library.encode(probe, out_type=str) != self._whole(SPACE + probe.replace(" ", SPACE)):
            raise ValueError("the model changes characters or is not a BPE model; its counts can not be compiled")
        if any(c not in self.score for p in self.score for c in p) or any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces must be made of single-character pieces and hold white space in front only")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}
        self._columns = np.full(0x110000, -1, np.int32)
        self._clear()

    def _whole(self, text: str) -> list[str]:
        out: list[str] = []
        for run in self._runs(text):
            out += self.merged(run) if run[0] in self.score else [f"<0x{b:02X}>" for b in run.encode()]
        return out

    def _runs(self, text: str):
        start = 0
        for i, c in enumerate(text):
            if c not in self.score:
                if start < i:
                    yield text[start:i]
                yield c
                start = i + 1
        if start < len(text):
            yield text[start:]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string: the best-scored adjacent pair is merged first, ties from the left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max((score.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _fits(self, before: str | None, piece: str) -> bool:
        alone = self._alone.get(piece)
        if alone is None:
            alone = self._alone[piece] = self.merged(piece) == [piece]
        if not alone or before is None:
            return alone
        fits = self._pairs.get((before, piece))
        if fits is None:
            fits = self._pairs[before, piece] = self.merged(before + piece) == [before, piece]
        return fits

    def _clear(self) -> None:
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        self._columns[:] = -1
        self.characters: list[str] = []
        self.width = 128
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full(1024 * self.width, -1, np.int32)
        self._number((None, ()))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n

    def columns(self, points: np.ndarray) -> np.ndarray:
        """The column of each code point, made where it is new."""
        found = self._columns[points]
        if found.size and found.min() < 0:
            for p in np.unique(points[found < 0]).tolist():
                self._columns[p] = len(self.characters)
                self.characters.append(chr(p))
            found = self._columns[points]
            if len(self.characters) > self.width:
                wide = self.width
                while wide < len(self.characters):
                    wide *= 2
                old = self.table.reshape(-1, self.width)
                table = np.full((len(old), wide), -1, np.int32)
                table[:, : self.width] = old
                self.table, self.width = table.reshape(-1), wide
        return found

    def step(self, state: tuple, c: str) -> tuple[tuple, int]:
        """The next state and the change of the token count."""
        last, open_ones = state
        if c not in self.score:
            return (None, ()), len(c.encode("utf-8", "surrogatepass"))
        if c == SPACE and last is not None and last[-1] != SPACE:
            last, open_ones = None, ()
        change, piece, grown = 0, None, []
        for text, before, gap in (*open_ones, ("", last, 0)):
            text = sys.intern(text + c)
            if piece is None and text in self.score and self._fits(before, text):
                piece, change = text, 1 - gap
            if text in self.opens:
                grown.append((text, before, gap))
        return (piece, tuple((t, b, g + change) for t, b, g in grown)), change

    def _fill(self, keys: np.ndarray) -> None:
        for key in np.unique(keys).tolist():
            at, column = divmod(key, self.width)
            state, change = self.step(self.states[at], self.characters[column])
            n = self._number(state)
            self.table[key] = n << 8 | change + 64

    def walk(self, columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray):
        """Exit states and counts of lanes ``columns[start : start + length]`` walked in lockstep."""
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], -lengths[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        for t in range(int(-sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(sizes, -t, "left"))
            column = columns[starts[:m] + t]
            keys = state[:m] * self.width + column
            value = self.table[keys]
            if value.min() < 0:
                self._fill(keys[value < 0])
                value = self.table[keys]
            state[:m] = value >> 8
            count[:m] += (value & 255) - 64
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) * self.width > CELLS:
            self._clear()
        full = [i for i, t in enumerate(texts) if t]
        total = np.zeros(len(texts), np.int64)
        if not full:
            return total
        joined = "".join([SPACE + texts[i] for i in full]).replace(" ", SPACE)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0] + [len(texts[i]) + 1 for i in full])
        columns = self.columns(points)
        # Characters that return to a fixed state: white space behind a word, and whatever no piece holds.
        blank = points == ord(SPACE)
        outside = np.array([c not in self.score for c in self.characters])[columns]
        back = outside.copy()
        back[1:] |= blank[1:] & ~blank[:-1]
        back[first[:-1]] = True
        pieces = -(-np.diff(first) // CHUNK)
        text_of = np.repeat(np.arange(len(full)), pieces)
        rank = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[text_of] + rank * CHUNK
        stop = np.minimum(start + CHUNK, first[text_of + 1])
        returns = np.append(np.flatnonzero(back), len(points))
        reset = np.minimum(returns[np.searchsorted(returns, start)], stop)
        exits, count = self.walk(columns, reset, stop - reset, np.zeros(len(start), np.int64))
        # The scan: a head takes the exit of the chunk before it; a chunk that never returns is all head.
        known = reset < stop
        todo = np.flatnonzero(reset > start)
        while len(todo):
            ready = todo[known[todo - 1]]
            out, more = self.walk(columns, start[ready], reset[ready] - start[ready], exits[ready - 1])
            count[ready] += more
            through = ready[~known[ready]]
            exits[through] = out[~known[ready]]
            done = np.zeros(len(start), bool)
            done[ready] = True
            known[through] = True
            todo = todo[~done[todo]]
        total[full] = np.add.reduceat(count, np.cumsum(pieces) - pieces)
        return total


def transducer(model: bytes) -> Transducer:
    """The transducer of a model, kept for later tasks of the same worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of every row.

    ``model`` is the path of a sentencepiece file that every machine has, like the library
    itself. Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are
    kept; other columns are not read; an empty table gives no rows.
    """

    def work(batches):
        with open(model, "rb") as file:
            machine = transducer(file.read())
        for part in slices(batches):
            texts = [t or "" for t in column_of(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                column_of(part, "id"), column_of(part, "n_bytes"), pa.array(machine.counts(texts)),
            ], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = source.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
