"""Topic models fitted over every document in every pass, several numbers of topics at once.

The model: a document's proportions are the softmax of its position ``eta``, which is normal around a prior
mean, and the mean is a linear function of the document's covariates. A pass moves the position of every
document uphill (Newton steps on the usual lower bound, halved until the document's own objective rises),
then sets topics and prior means to their best values for these positions. No step can lower the joint
objective, so it rises from pass to pass.

Where the tables are: documents stand in slices of bounded size, one row each, with their positions, and stay
where they are from pass to pass; topics are a table of blocks of ``BLOCK`` terms. A table of up to ``WHOLE`` blocks
is joined to every slice; of a larger one a slice is sent the blocks its terms lie in. Sums come back by block and
are added in a tree. The driver sees only sums over all documents: one number for each topic and covariate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, swept, written

#: Stored cells of a slice of documents, terms of a block, and tables that one task adds up.
SLICE_CELLS = 50_000
BLOCK = 1024
FAN = 32
#: Blocks that are joined to every slice as one table; more are sent by slice.
WHOLE = 8
#: Slices in a partition at most, and passes after which documents and positions are written: a lost executor costs no more passes, and plans, which hold those before, stay small.
TOGETHER = 32
KEPT = 6
#: Documents x terms of a slice that are multiplied at once.
DENSE = 1 << 18
#: Variance of positions around their prior mean.
VARIANCE = 1.0
#: Random directions onto which word co-occurrence is projected.
DIRECTIONS = 128
#: Terms of less than this share of the mean term's weight are no anchors: their co-occurrence is mostly chance.
CANDIDATE = 0.25
_STEP = "kind string, key long, part long, payload binary, sums array<double>"


class Counts:
    """Counts of some documents: the filled cells of documents x terms, and where they stand among those it was cut from."""

    def __init__(self, at: np.ndarray, n: np.ndarray, many: int, terms: int, cells: np.ndarray | None = None):
        self.at, self.n, self.many, self.terms = at, n, many, terms
        self.rows = at // max(1, terms)
        self.cells = np.arange(len(at)) if cells is None else cells
        self.full = self.product = None

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, values, self.many)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Documents x terms with ``values`` in the filled cells, in the same memory for each call."""
        if self.full is None:
            self.full = np.zeros(self.many * self.terms)
        self.full[self.at] = values
        return self.full.reshape(self.many, self.terms)

    def mixed(self, theta: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """The filled cells of the product of proportions and topics."""
        if self.product is None:
            self.product = np.empty((self.many, self.terms))
        return np.matmul(theta, beta.T, out=self.product).ravel()[self.at]

    def of(self, chosen: np.ndarray) -> Counts:
        """The counts of the chosen documents alone."""
        keep, place = chosen[self.rows], np.cumsum(chosen) - 1
        rows = self.rows[keep]
        return Counts(self.at[keep] + (place[rows] - rows) * self.terms, self.n[keep], int(chosen.sum()), self.terms, self.cells[keep])


def _list_column(rows: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The joined values of an array field, and where each row's begin and the last end."""
    lists = pc.struct_field(rows, [name])
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


class Slice:
    """The documents of a row: term places, counts and covariates, as arrays. Places of a document are in order, each one once."""

    def __init__(self, docs: pa.Array):
        index, ends = _list_column(docs, "idx")
        n = _list_column(docs, "n")[0].astype(float)
        self.many = len(docs)
        self.terms, at = np.unique(index, return_inverse=True)
        places, own = np.unique(np.repeat(np.arange(self.many), np.diff(ends)) * len(self.terms) + at, return_inverse=True)
        n = np.bincount(own, n, len(places))
        places, self.n = places[n != 0], n[n != 0]
        rows, self.at = np.divmod(places, max(1, len(self.terms)))
        self.ends = np.searchsorted(rows, np.arange(self.many + 1))
        self.x = _list_column(docs, "x")[0].reshape(self.many, -1)

    def payload(self) -> bytes:
        """All of it as bytes, which pass between Spark and Python as they are."""
        sizes = np.array([self.many, len(self.terms), len(self.n)], np.int64)
        parts = [sizes, self.terms.astype(np.int64), self.ends.astype(np.int64), self.n, self.x.ravel(), self.at.astype(np.int32)]
        return b"".join(part.tobytes() for part in parts)

    @classmethod
    def of(cls, payload: pa.Buffer) -> Slice:
        own = cls.__new__(cls)
        own.many, terms, cells = np.frombuffer(payload, np.int64, 3).tolist()
        own.terms = np.frombuffer(payload, np.int64, terms, 24)
        own.ends = np.frombuffer(payload, np.int64, own.many + 1, 24 + 8 * terms)
        after = 24 + 8 * (terms + own.many + 1)
        own.n = np.frombuffer(payload, float, cells, after)
        last = payload.size - 4 * cells
        own.x = np.frombuffer(payload, float, (last - after) // 8 - cells, after + 8 * cells).reshape(own.many, -1)
        own.at = np.frombuffer(payload, np.int32, cells, last)
        return own

    def chunks(self):
        """``first, last`` document and the counts of as many documents as fit."""
        terms = len(self.terms)
        step = max(1, DENSE // max(1, terms))
        for a in range(0, self.many, step):
            b = min(self.many, a + step)
            cells = slice(self.ends[a], self.ends[b])
            places = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])) * terms + self.at[cells]
            yield a, b, Counts(places, self.n[cells], b - a, terms)

    def gathered(self, blocks: pa.Array, width: int) -> np.ndarray:
        """The rows of its terms from blocks of term rows."""
        out = np.zeros((len(self.terms), width))
        for b in blocks:
            key = b["key"].as_py()
            own = slice(*np.searchsorted(self.terms, [key * BLOCK, (key + 1) * BLOCK]))
            held = np.frombuffer(b["payload"].as_buffer(), float).reshape(-1, width)
            out[own] = held[self.terms[own] - key * BLOCK]
        return out

    def by_block(self, rows: np.ndarray):
        """Rows of its terms dealt to blocks: key and payload."""
        for key in np.unique(self.terms // BLOCK).tolist():
            own = slice(*np.searchsorted(self.terms, [key * BLOCK, (key + 1) * BLOCK]))
            full = np.zeros((BLOCK, rows.shape[1]))
            full[self.terms[own] - key * BLOCK] = rows[own]
            yield key, full.tobytes()


def softmax(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def uphill(counts: Counts, beta: np.ndarray, eta: np.ndarray, mean: np.ndarray, steps: int):
    """Positions after ``steps`` steps, their proportions, the mixture's share of each filled cell, and each document's objective."""
    total = counts.per_document(counts.n)[:, None]

    def judged(own, eta, mean):
        theta = softmax(eta)
        share = np.maximum(own.mixed(theta, beta), 1e-300)
        return theta, share, own.per_document(own.n * np.log(share)) - ((eta - mean) ** 2).sum(axis=1) / (2 * VARIANCE)

    eta = eta.copy()
    theta, share, value = judged(counts, eta, mean)
    for _ in range(steps):
        gradient = theta * (counts.spread(counts.n / share) @ beta) - total * theta - (eta - mean) / VARIANCE
        inverse = 1 / (total * theta + 1 / VARIANCE)
        # the curvature of the bound is diagonal less one outer product
        u, v = inverse * gradient, inverse * theta
        move = u + v * (total * (theta * u).sum(axis=1, keepdims=True) / np.maximum(1 - total * (theta * v).sum(axis=1, keepdims=True), 1e-12))
        tried = eta + move
        new = judged(counts, tried, mean)
        better = new[2] >= value
        if better.all():
            eta, (theta, share, value) = tried, new
            continue
        left, own = np.arange(counts.many), counts
        for again in range(8):
            if again:
                tried = eta[left] + move[left]
                new = judged(own, tried, mean[left])
                better = new[2] >= value[left]
            cells = better[own.rows]
            eta[left[better]], theta[left[better]], share[own.cells[cells]], value[left[better]] = tried[better], new[0][better], new[1][cells], new[2][better]
            if better.all():
                break
            left, own = left[~better], own.of(~better)
            move[left] /= 2
    return eta, theta, share, value


def packed(vectors: DataFrame, document: str = "document", covariates: DataFrame | None = None, key: str = "document") -> DataFrame:
    """``slice, docs``: documents with at least one term, in slices that depend on nothing but the documents.

    ``vectors`` has term places and counts, as ``idx`` and ``n`` or as a sparse vector ``features``. Covariates
    are put on one scale; a missing one counts as the mean. Each document gets a leading 1.
    """
    if "features" in vectors.columns:
        stored = F.unwrap_udt("features")
        dense = F.filter(F.sequence(F.lit(0), F.size(stored["values"]) - 1), lambda i: F.get(stored["values"], i) > 0)
        idx, n = F.coalesce(stored["indices"], dense), F.filter(stored["values"], lambda v: v > 0)
        vectors = vectors.select(F.col(document).alias("document"), idx.alias("idx"), n.alias("n"))
    rows = vectors.select(F.col(document).alias("document") if "document" not in vectors.columns else "document", "idx", F.col("n").cast("array<double>").alias("n")).where(F.size("idx") > 0)
    ones = F.lit(1.0)
    if covariates is None:
        rows = rows.withColumn("x", F.array(ones))
    else:
        names = [c for c in covariates.columns if c != key]
        own = covariates.select(F.col(key).alias("document"), *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(names)])
        rows = written(rows.join(own, "document", "left"), "documents")
        figures = rows.agg(*[f(F.col(f"x_{i}")).alias(f"{f.__name__}_{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop)]).head()
        scaled = [
            F.coalesce((F.col(f"x_{i}") - figures[2 * i]) / figures[2 * i + 1], F.lit(0.0)) if figures[2 * i + 1] else F.lit(0.0) for i in range(len(names))
        ]
        rows = rows.withColumn("x", F.array(ones, *scaled))
    rows = written(rows.select("document", "idx", "n", "x"), "documents")
    cells = rows.agg(F.sum(F.size("idx"))).head()[0] or 0
    many = max(1, -(-cells // SLICE_CELLS))
    own = F.pmod(F.xxhash64(F.col("document")), F.lit(many)).alias("slice")
    docs = F.array_sort(F.collect_list(F.struct("document", "idx", "n", "x"))).alias("docs")
    return written(rows.groupBy(own).agg(docs), "slices")


def needed_blocks(slices: DataFrame) -> DataFrame:
    """``slice, key``: the blocks in which a slice has terms."""
    keys = F.array_distinct(F.flatten(F.transform("docs", lambda d: F.transform(d["idx"], lambda i: F.floor(i / BLOCK)))))
    return written(slices.select("slice", F.explode(keys).alias("key")), "needed")


def added(parts: DataFrame, width: int, many: int, divisor: Sequence[float] | None = None) -> DataFrame:
    """``key, payload``: the sum of each block over all parts, in a tree of fan ``FAN``; columns divided at the end."""

    def summing(by):
        def work(table: pa.Table) -> pa.Table:
            total = np.zeros((BLOCK, width))
            for payload in table["payload"]:
                total += np.frombuffer(payload.as_buffer(), float).reshape(BLOCK, width)
            if by is not None:
                total /= np.maximum(by, 1e-300)
            return pa.table({"key": table["key"][:1], "part": table["part"][:1], "payload": pa.array([total.tobytes()], pa.binary())})

        return work

    while many > 1:
        many = -(-many // FAN)
        up = parts.select("key", F.floor(F.col("part") / FAN).alias("part"), "payload")
        last = np.asarray(divisor) if divisor is not None and many == 1 else None
        parts = up.groupBy("key", "part").applyInArrow(summing(last), "key long, part long, payload binary")
    return parts.select("key", "payload")


def _stage(df: DataFrame) -> tuple[dict[str, DataFrame], np.ndarray]:
    """Write what slices return; tables by kind, and the sums over all slices."""
    path = scratch_path(df.sparkSession, "pass")
    df.write.partitionBy("kind").parquet(path)
    kept = df.sparkSession.read.schema(_STEP).parquet(path)
    tables = {kind: kept.where(F.col("kind") == kind) for kind in ("block", "eta", "sums")}
    return tables, _totals(kept)


def _totals(parts: DataFrame) -> np.ndarray:
    """The sums over all slices."""
    sums = parts.where(F.col("kind") == "sums").select(F.posexplode("sums").alias("at", "s"))
    return np.array([r["s"] for r in sorted(sums.groupBy("at").agg(F.sum("s").alias("s")).collect())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]
    columns = list(zip(*found)) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "key", "part", "payload", "sums"])


def directions(terms: np.ndarray) -> np.ndarray:
    """A random sign for each term and direction, the same wherever it is drawn."""
    words = np.arange(1, DIRECTIONS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (terms.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) + words
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.unpackbits(h.view(np.uint8), axis=1).astype(float) * 2 - 1


def cooccurrence(slices: DataFrame, many: int) -> DataFrame:
    """``key, payload``: for each term its weight, and its co-occurrence with all terms projected onto random directions."""

    def work(batches):
        for batch in batches:
            for docs, part in zip(batch.column("docs"), batch.column("slice").to_pylist()):
                own = Slice(docs.values)
                signs, out = directions(own.terms), np.zeros((len(own.terms), DIRECTIONS + 1))
                for _, _, counts in own.chunks():
                    dense = counts.spread(counts.n)
                    total = dense.sum(axis=1)
                    use = total > 1
                    dense, total = dense[use], total[use]
                    pairs = dense / (total * (total - 1))[:, None]
                    out[:, 0] += (dense / total[:, None]).sum(axis=0)
                    out[:, 1:] += pairs.T @ (dense @ signs) - pairs.sum(axis=0)[:, None] * signs
                yield _rows([("block", key, part, payload, None) for key, payload in own.by_block(out)])

    return written(added(_dealt(slices.select("slice", "docs"), many).mapInArrow(work, _STEP), DIRECTIONS + 1, many), "cooccurrence")


def farthest(rows: np.ndarray, many: int) -> list[int]:
    """Greedy Gram-Schmidt: rows, each the farthest from the span of those before it."""
    left, chosen = rows.copy(), []
    first = None
    while len(chosen) < min(many, len(rows)):
        size = (left * left).sum(axis=1)
        best = int(np.argmax(size))
        first = first or size[best]
        if size[best] <= 1e-10 * max(first, 1e-300):
            break
        chosen.append(best)
        axis = left[best] / np.sqrt(size[best])
        left = left - np.outer(left @ axis, axis)
    return chosen


def anchors(table: DataFrame, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and profiles of ``many`` anchor terms, each the farthest from the span of those before it.

    Blocks choose among their own terms, then ``FAN`` blocks at a time among what these chose, up to one list.
    """

    def weighed(t: pa.Table) -> pa.Table:
        weight = np.frombuffer(t["payload"][0].as_buffer(), float).reshape(BLOCK, -1)[:, 0]
        return pa.table({"s": [float(weight.sum())], "n": [int((weight > 0).sum())]})

    total, terms = table.groupBy("key").applyInArrow(weighed, "s double, n long").agg(F.sum("s"), F.sum("n")).head()
    least = CANDIDATE * (total or 0.0) / (terms or 1)

    def chosen(place: np.ndarray, rows: np.ndarray) -> pa.Table:
        best = farthest(rows, many)
        return pa.table({
            "key": pa.array([0], pa.int64()), "place": pa.array([place[best].astype(np.int64).tobytes()], pa.binary()), "payload": pa.array([rows[best].tobytes()], pa.binary())})

    def of_block(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(t["payload"][0].as_buffer(), float).reshape(BLOCK, -1)
        used = np.flatnonzero((rows[:, 0] > 0) & (rows[:, 0] >= least))
        out = chosen(used + t["key"][0].as_py() * BLOCK, rows[used, 1:] / rows[used, :1])
        return out.set_column(0, "key", t["key"][:1])

    def of_several(t: pa.Table) -> pa.Table:
        place = np.concatenate([np.frombuffer(p.as_buffer(), np.int64) for p in t["place"]])
        rows = np.concatenate([np.frombuffer(p.as_buffer(), float) for p in t["payload"]]).reshape(-1, DIRECTIONS)
        order = np.argsort(place)
        return chosen(place[order], rows[order]).set_column(0, "key", t["key"][:1])

    schema = "key long, place binary, payload binary"
    best = table.groupBy("key").applyInArrow(of_block, schema)
    top = table.agg(F.max("key")).head()[0]
    while top and top > 0:
        best = best.withColumn("key", F.floor(F.col("key") / FAN)).groupBy("key").applyInArrow(of_several, schema)
        top //= FAN
    row = best.head()
    if row is None:
        return np.zeros(0, np.int64), np.zeros((0, DIRECTIONS))
    return np.frombuffer(row["place"], np.int64), np.frombuffer(row["payload"], float).reshape(-1, DIRECTIONS)


def mixtures(rows: np.ndarray, corners: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights, which sum to one, of the corners whose mixture is nearest to each row, by exponentiated gradient."""
    product = corners @ corners.T
    rate = 1 / max(np.abs(product).sum(axis=1).max(), 1e-300)
    target, weights = rows @ corners.T, np.full((len(rows), len(corners)), 1 / max(1, len(corners)))
    for _ in range(rounds):
        slope = weights @ product - target
        weights = weights * np.exp(-8 * rate * (slope - slope.min(axis=1, keepdims=True)))
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def spectral_start(slices: DataFrame, many: int, ks: Sequence[int]) -> DataFrame:
    """Blocks of topics from anchor terms: each term's profile as a mixture of the anchors', times its weight.

    Anchors are chosen once; a model of k topics has the first k. Topics beyond the anchors found start near the mean.
    """
    table = cooccurrence(slices, many)
    _, profiles = anchors(table, max(ks))

    def work(batches):
        for batch in batches:
            for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload")):
                rows = np.frombuffer(payload.as_buffer(), float).reshape(BLOCK, -1)
                weight = rows[:, :1]
                shape = rows[:, 1:] / np.maximum(weight, 1e-300)
                noise = (directions(np.arange(key * BLOCK, (key + 1) * BLOCK)) + 3) / 4
                out = []
                for k in ks:
                    found = mixtures(shape, profiles[:k])
                    more = noise[:, np.arange(k - found.shape[1]) % DIRECTIONS] / k
                    out.append(weight * (np.concatenate([found, more], axis=1) * 0.99 + 0.01 / k))
                full = np.concatenate(out, axis=1)
                yield _rows([("block", key, 0, full.tobytes(), None), ("sums", key, 0, None, full.sum(axis=0).tolist())])

    return table.mapInArrow(work, _STEP)


@dataclass
class Fit:
    """Models fitted together; ``blocks`` holds the topics of all, side by side."""

    ks: tuple[int, ...]
    slices: DataFrame
    blocks: DataFrame
    positions: DataFrame
    bounds: dict[int, list[float]]
    effects: dict[int, np.ndarray]
    documents: str
    places: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        at = np.concatenate(([0], np.cumsum(self.ks)))
        self.places = {k: int(a) for k, a in zip(self.ks, at)}

    @property
    def width(self) -> int:
        return int(sum(self.ks))

    def terms(self, vocab: DataFrame) -> DataFrame:
        """``K, topic, term, beta`` of all models in one scan."""
        width = self.width

        def work(batches):
            for batch in batches:
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload")):
                    rows = np.frombuffer(payload.as_buffer(), float)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(BLOCK + 1, dtype=np.int32) * width), pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(key * BLOCK, (key + 1) * BLOCK)), values], ["idx", "w"])

        rows = self.blocks.mapInArrow(work, "idx long, w array<double>").join(vocab.select("idx", "term"), "idx")
        return self._unfolded(rows, "w", ["term"], "beta")

    def _unfolded(self, rows: DataFrame, values: str, keys: list[str], name: str) -> DataFrame:
        per_k = F.explode(F.array(*[F.struct(F.lit(k).alias("K"), F.slice(values, self.places[k] + 1, k).alias("v")) for k in self.ks])).alias("m")
        rows = rows.select(*keys, per_k).select(F.col("m.K").alias("K"), *keys, F.posexplode("m.v").alias("at", name))
        return rows.select("K", (F.col("at") + 1).alias("topic"), *keys, name)

    def docs(self) -> DataFrame:
        """``K, document, topic, gamma`` of the fitted documents for all models in one scan."""
        return self._long(self._proportions(self.slices.join(self.positions, "slice")))

    def mixtures(self) -> DataFrame:
        """``document, values``: the same, all models side by side in one array, in order of K."""
        by_k = F.concat(*[F.slice("theta", self.places[k] + 1, k) for k in sorted(self.ks)])
        return self._proportions(self.slices.join(self.positions, "slice")).select("document", by_k.alias("values"))

    def _long(self, rows: DataFrame) -> DataFrame:
        return self._unfolded(rows, "theta", ["document"], "gamma")

    def _proportions(self, rows: DataFrame) -> DataFrame:
        ks, width, at = self.ks, self.width, self.places

        def work(batches):
            for batch in batches:
                for docs, eta in zip(batch.column("docs"), batch.column("eta")):
                    eta = np.frombuffer(eta.as_buffer(), float).reshape(-1, width)
                    theta = np.concatenate([softmax(eta[:, at[k] : at[k] + k]) for k in ks], axis=1)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(theta) + 1, dtype=np.int32) * width), pa.array(theta.ravel()))
                    yield pa.RecordBatch.from_arrays([pc.struct_field(docs.values, ["document"]), values], ["document", "theta"])

        return rows.select("docs", "eta").mapInArrow(work, f"document {self.documents}, theta array<double>")

    def infer(self, vectors: DataFrame, steps: int = 30) -> DataFrame:
        """``K, document, topic, gamma`` of any documents, for all models in one scan of them; the prior mean is that of an average document."""
        slices = packed(vectors)
        many = (slices.agg(F.max("slice")).head()[0] or 0) + 1
        rows = _met(_dealt(slices, many), needed_blocks(slices), self.blocks, _small(self.blocks))
        ks, width, at = self.ks, self.width, self.places
        means = {k: self.effects[k][0] for k in ks}

        def work(batches):
            for batch in batches:
                for part, docs, blocks in zip(batch.column("slice").to_pylist(), batch.column("docs"), batch.column("blocks")):
                    own, eta = Slice(docs.values), []
                    beta = own.gathered(blocks, width)
                    for _, _, counts in own.chunks():
                        parts = []
                        for k in ks:
                            mean = np.repeat(means[k][None, :], counts.many, axis=0)
                            parts.append(uphill(counts, beta[:, at[k] : at[k] + k], mean, mean, steps)[0])
                        eta.append(np.concatenate(parts, axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.concatenate(eta).tobytes()], pa.binary())], ["slice", "eta"])

        found = written(rows.select(F.col("slice").cast("long").alias("slice"), "docs", "blocks").mapInArrow(work, "slice long, eta binary"), "eta")
        return self._long(self._proportions(slices.join(found, "slice")))


def _partitions(slices: DataFrame, many: int) -> int:
    """As many as the session has for shuffles: the work is in fitting, not in the bytes by which partitions are merged."""
    usual = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(many, usual), -(-many // TOGETHER))


def _dealt(slices: DataFrame, many: int) -> DataFrame:
    return slices.repartition(_partitions(slices, many))


def _small(blocks: DataFrame) -> bool:
    return blocks.select("key").limit(WHOLE + 1).count() <= WHOLE


def _met(rows: DataFrame, needed: DataFrame, blocks: DataFrame, whole: bool) -> DataFrame:
    """``rows``, which have a column ``slice``, with the blocks of topics: a small table whole, so that rows stay where they are."""
    listed = F.collect_list(F.struct("key", "payload")).alias("blocks")
    if whole:
        # one row, read by each task; without an exchange, plans of passes kept on one another stay small
        return rows.crossJoin(written(blocks.agg(listed), "topics").coalesce(1).hint("shuffle_replicate_nl"))
    return rows.join(needed.join(blocks, "key").groupBy("slice").agg(listed), "slice")


def fit(
    vectors: DataFrame, ks: Sequence[int], max_iter: int = 200, tolerance: float = 1e-5, steps: int = 2,
    covariates: DataFrame | None = None, key: str = "document",
) -> Fit:
    """Fit a model for each number of topics in the same passes, from a spectral start.

    Every pass reads every document. The passes end when no objective grows by more than ``tolerance`` of itself,
    or after ``max_iter``. ``covariates`` (a row for each document, named by ``key``) move the prior means; without them
    all documents have the same prior mean, which is fitted as well.
    """
    ks = tuple(ks)
    slices = packed(vectors, covariates=covariates, key=key)
    kind = slices.schema["docs"].dataType.elementType["document"].dataType.simpleString()
    head = slices.agg(F.max("slice"), F.max(F.size(F.get("docs", F.lit(0))["x"]))).head()
    many, p = (head[0] or 0) + 1, head[1] or 1
    needed = needed_blocks(slices)
    width = sum(ks)
    at = np.concatenate(([0], np.cumsum(ks))).astype(int)
    tables, sums = _stage(spectral_start(slices, many, ks))
    blocks = written(added(tables["block"], width, 2, sums[:width] if len(sums) else np.ones(width)), "topics")
    prior, whole = np.zeros((p, width)), _small(blocks)
    bounds: dict[int, list[float]] = {k: [] for k in ks}

    schema = f"{_STEP}, docs binary"

    def compact(batches):
        for batch in batches:
            for part, docs in zip(batch.column("slice").to_pylist(), batch.column("docs")):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([Slice(docs.values).payload()], pa.binary())], ["slice", "docs"])

    def one_pass(prior):
        def work(batches):
            # sums of the blocks that all slices of a task share, up to what the whole table may hold, and of what the driver sees
            held, first, total = {}, None, 0.0
            for batch in batches:
                for row, (part, docs, blocks, before) in enumerate(zip(*(batch.column(c) for c in ("slice", "docs", "blocks", "eta")))):
                    own = Slice.of(docs.as_buffer())
                    beta, mean = own.gathered(blocks, width), own.x @ prior
                    eta = np.frombuffer(before.as_buffer(), float).reshape(-1, width).copy() if before.is_valid else mean.copy()
                    stats, value = np.zeros_like(beta), np.zeros(len(ks))
                    for a, b, counts in own.chunks():
                        for m in range(len(ks)):
                            cols = slice(at[m], at[m + 1])
                            eta[a:b, cols], theta, share, worth = uphill(counts, beta[:, cols], eta[a:b, cols], mean[a:b, cols], steps)
                            stats[:, cols] += beta[:, cols] * (counts.spread(counts.n / share).T @ theta)
                            value[m] += worth.sum()
                    total = total + np.concatenate([stats.sum(axis=0), value, (own.x.T @ own.x).ravel(), (own.x.T @ eta).ravel()])
                    part = part.as_py()
                    # a whole table is all held, so its parts are those of tasks
                    first = (TaskContext.get().partitionId() if whole else part) if first is None else first
                    yield with_docs([("eta", part, part, eta.tobytes(), None)], batch.column("docs").slice(row, 1))
                    found = []
                    for key, payload in own.by_block(stats):
                        if key in held or len(held) < WHOLE:
                            held[key] = held.get(key, 0) + np.frombuffer(payload)
                        else:
                            found.append(("block", key, part, payload, None))
                    if found:
                        yield with_docs(found, pa.nulls(len(found), pa.binary()))
            if first is not None:
                found = [("sums", first, first, None, total.tolist())] + [("block", key, first, sums.tobytes(), None) for key, sums in held.items()]
                yield with_docs(found, pa.nulls(len(found), pa.binary()))

        return work

    def with_docs(found, docs):
        rows = _rows(found)
        return pa.RecordBatch.from_arrays([*rows.columns, docs], [*rows.schema.names, "docs"])

    dealt = _dealt(slices.select(F.col("slice").cast("long").alias("slice"), "docs"), many)
    parts = _partitions(slices, many) if whole else many
    state, kept = dealt.mapInArrow(compact, "slice long, docs binary").withColumn("eta", F.lit(None).cast("binary")), None
    for passes in range(max_iter):
        # documents and positions stay in the executors, in memory or on their disks; only sums by block are shuffled
        step = _met(state, needed, blocks, whole).select("slice", "docs", "blocks", "eta").mapInArrow(one_pass(prior), schema).persist(StorageLevel.MEMORY_AND_DISK)
        sums = _totals(step)
        state = step.where(F.col("kind") == "eta").select(F.col("key").alias("slice"), "docs", F.col("payload").alias("eta"))
        if not whole or passes % KEPT == KEPT - 1:
            state = cut_lineage(state)
        if kept is not None:
            kept.unpersist()
        kept = step
        if not len(sums):
            break
        for m, k in enumerate(ks):
            bounds[k].append(float(sums[width + m]))
        rest = sums[width + len(ks) :]
        prior = np.linalg.lstsq(rest[: p * p].reshape(p, p), rest[p * p :].reshape(p, width), rcond=None)[0]
        blocks = added(step.where(F.col("kind") == "block"), width, max(parts, 2), sums[:width])
        blocks = blocks if whole else written(blocks, "topics")
        if passes and passes % KEPT == 0:
            swept(slices.sparkSession)  # from here on the last documents and positions written are needed, and none before
        if all(len(b) > 1 and b[-1] - b[-2] <= tolerance * abs(b[-2]) for b in bounds.values()):
            break
    blocks = written(blocks, "topics")
    eta = written(state.where(F.col("eta").isNotNull()).select("slice", "eta"), "eta")
    if kept is not None:
        kept.unpersist()
    return Fit(ks, slices, blocks, eta, bounds, {k: prior[:, a : a + k] for k, a in zip(ks, at)}, kind)
