"""A quality classifier learned from trusted good documents and unlabelled text.

Non-negative positive-unlabelled learning: the risk on bad documents is written as the
risk on unlabelled ones less the share of good ones among them, and held at zero from
below, so that a flexible model can not drive it negative. The share of good documents is
estimated as the least ratio of the tails of a first, positive-against-unlabelled score.
The model is logistic on binned figures of form (characters, repetition, words, lines);
what a text is about, its language, source and id are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, span_hashes, utf8, word_spans

#: Positive and unlabelled documents that are fitted, at most so many of each.
SAMPLE = 20_000
BINS = 24
#: Bytes of text whose figures are made at once: a worker holds some dozen numbers for each, and keeps its tables of powers.
AT_ONCE = 1 << 17
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?'\"()-", b"!"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
FIGURES = (
    "letters", "capitals", "digits", "blanks", "breaks", "stops", "exclamations", "foreign", "symbols", "words", "word_length",
    "longest_word", "distinct", "distinct_scaled", "pairs", "pairs_scaled", "same_as_before", "capital_words", "symbol_words", "line_words", "distinct_lines",
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` within each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=count)


def figures(texts: pa.Array) -> np.ndarray:
    """A row of figures of form for every text; null and empty texts have zeros."""
    data, offsets = utf8(texts)
    kinds, count = _CLASS[data], len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    by_kind = [_per_text(kinds == k, offsets) for k in range(9)]
    starts, ends, first = word_spans(data, offsets, (kinds != 4) & (kinds != 5))
    n = np.diff(first)
    words = np.maximum(n, 1)
    text = np.repeat(np.arange(count), n)
    hashes = span_hashes(data, starts, ends)
    distinct = _distinct(hashes, text, count)
    together = np.zeros(len(hashes), bool)
    together[1:] = text[1:] == text[:-1]
    two = np.flatnonzero(together)
    pairs = _distinct(hashes[two] * np.uint64(31) + hashes[two - 1], text[two], count)
    same = np.zeros(len(hashes), bool)
    same[two] = hashes[two] == hashes[two - 1]
    span = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds == 2, out=span[1:])
    capital = 2 * (span[ends] - span[starts]) > ends - starts
    np.cumsum(kinds == 0, out=span[1:])
    symbol = span[ends] - span[starts] > 0
    line_starts, line_ends, line_first = word_spans(data, offsets, kinds != 5)
    lines = np.diff(line_first)
    line_text = np.repeat(np.arange(count), lines)
    alike = _distinct(span_hashes(data, line_starts, line_ends), line_text, count)
    length = ends - starts
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, text, length)
    log = lambda x: np.log(np.maximum(x, 1))
    scaled = lambda part, whole: np.where(whole > 1, log(part) / np.maximum(log(whole), 1e-9), 1.0)
    columns = [
        by_kind[1] / size, by_kind[2] / size, by_kind[3] / size, by_kind[4] / size, by_kind[5] / size, by_kind[6] / size,
        by_kind[7] / size, by_kind[8] / size, by_kind[0] / size, log(n), _per_text(length, first) / words, log(longest),
        distinct / words, scaled(distinct, n), pairs / np.maximum(n - 1, 1), scaled(pairs, n - 1), _per_text(same, first) / words,
        _per_text(capital, first) / words, _per_text(symbol, first) / words, log(n / np.maximum(lines, 1)), alike / np.maximum(lines, 1),
    ]
    out = np.stack(columns, axis=1)
    out[n == 0] = 0.0
    return out


def figures_by_slice(texts: pa.Array) -> np.ndarray:
    """Figures of any number of texts, in memory for ``AT_ONCE`` bytes of them."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    found = [figures(column_of(part, "text")) for part in slices([batch], limit=AT_ONCE)]
    return np.concatenate(found) if found else np.zeros((0, len(FIGURES)))


class Model:
    """Weights of the bins of every figure."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def bins(self, rows: np.ndarray) -> np.ndarray:
        wide = self.edges.shape[1] + 1
        found = [np.searchsorted(e, rows[:, k], "right") + k * wide for k, e in enumerate(self.edges)]
        return np.stack(found, axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), 0.5)
        return _sigmoid(self.weights[self.bins(rows)].sum(axis=1) + self.weights[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, size: int, prior: float | None, steps: int = 600) -> np.ndarray:
    """Adam on the non-negative risk; without a prior, plain positive against unlabelled."""
    weights, mean, spread = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    decay = (10 if prior is None else 0.2) / (len(positive) + len(unlabelled))
    add = lambda at, pull: np.bincount(at.ravel(), np.repeat(pull, at.shape[1]), size + 1)
    for step in range(1, steps + 1):
        good = _sigmoid(weights[positive].sum(axis=1) + weights[-1])
        other = _sigmoid(weights[unlabelled].sum(axis=1) + weights[-1])
        n, m = len(positive), len(unlabelled)
        if prior is None:
            to_good, to_other = (good - 1) / n, other / m
        else:
            loss = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-12)).mean()
            bad = loss(other) - prior * loss(good)
            if bad >= 0:
                to_good, to_other = prior * (good - 1) / n - prior * good / n, other / m
            else:  # the negative part is below zero: step back from it
                to_good, to_other = prior * good / n, -other / m
        gradient = add(positive, to_good) + add(unlabelled, to_other) + decay * weights
        gradient[-1] = to_good.sum() + to_other.sum()
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        weights = weights - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return weights


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails that sampling allows."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.02, 0.9, 89)))
    tail = lambda s: np.array([(s >= c).mean() for c in cuts])
    p, u = tail(positive), tail(unlabelled)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, bins: int = BINS) -> Model:
    """Fit rows of figures; the prior is estimated on a half that the first score has not seen."""
    edges = np.stack([np.quantile(np.concatenate([positive[:, k], unlabelled[:, k]]), np.linspace(0, 1, bins + 1)[1:-1]) for k in range(positive.shape[1])])
    model = Model(edges, np.zeros(0), 0.5)
    size = edges.shape[0] * bins
    p, u = model.bins(positive), model.bins(unlabelled)
    first = _descend(p[::2], u[::2], size, None)
    score = lambda rows: first[rows].sum(axis=1)
    prior = prior_of(score(p[1::2]), score(u[1::2])) if len(p) > 1 and len(u) > 1 else 0.5
    return Model(edges, _descend(p, u, size, prior), prior)


def scores(text: Column, model: Model) -> Column:
    """The score of a text as a column: Arrow batches in, numbers out."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(figures_by_slice(texts)))

    return score(text)


def training_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, sample: int) -> np.ndarray:
    """Figures of at most ``sample`` documents of ``ids``, chosen by a hash of the id."""
    chosen = ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` ids
    held = held.groupBy("id").agg(F.min("text").alias("text"))  # rows that share an id count once

    @F.arrow_udf("array<double>")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array(list(figures_by_slice(texts)), pa.list_(pa.float64()))

    found = [r[1] for r in sorted(held.select("id", rows("text").alias("f")).collect())]  # at most `sample` rows
    return np.array(found).reshape(-1, len(FIGURES))


def held_out(id_col: str) -> Column:
    """One fold in five, by CRC-32 of the id as text; rows without an id are in none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE,
) -> Model:
    """Fit on labelled good documents and on documents at large, both outside the held-out fold."""
    good = labels.where((F.col(label_col) == 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"))
    every = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"))
    positive = training_rows(docs, good, id_col, text_col, sample)
    unlabelled = training_rows(docs, every, id_col, text_col, sample)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((0, 0)), np.zeros(0), 0.5)
    return fit(positive, unlabelled)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and their score; rows, columns and order of columns stay as they are."""
    return docs.withColumn(score_col, scores(F.col(text_col), model))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts are scored as texts without words; repeated rows and null ids are kept;
    labels that are null, or of no document, are not used; without any usable label every score is
    0.5; other columns are not read; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    out = with_scores(docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")), model)
    return out.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    return with_scores(docs, model, text_col, "__score").where(F.col("__score") >= threshold).drop("__score")
