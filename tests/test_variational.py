"""Topic fits on planted corpora."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forumgauge.catalog.topics import _trimmed
from forumgauge.operators import topics as tp
from forumgauge.operators import variational as va

K, TERMS = 3, 60


def planted(documents=240, seed=1, year_effect=0.0):
    """Documents of three topics; terms 0 to 2 occur in one topic each, the others in all; the share of topic 0 moves with the year."""
    rng = np.random.default_rng(seed)
    beta = rng.gamma(0.3, size=(K, TERMS)) + 1e-3
    beta[:, :K] = np.diag([3.0] * K)
    beta /= beta.sum(axis=1, keepdims=True)
    rows = []
    for d in range(documents):
        level = rng.normal(0, 1, K)
        level[0] += year_effect * (d % 5 - 2)
        theta = np.exp(level) / np.exp(level).sum()
        n = rng.multinomial(rng.integers(80, 200), theta @ beta)
        rows.append((f"d{d}", np.flatnonzero(n).tolist(), n[n > 0].astype(float).tolist(), 2018 + d % 5, 1 + d % 12))
    return beta, rows


SCHEMA = "document string, idx array<long>, n array<double>, year int, month int"


@pytest.fixture(scope="module")
def corpus(spark):
    beta, rows = planted()
    return beta, spark.createDataFrame(rows, SCHEMA).select("document", "idx", "n"), rows


def topics_of(spark, model):
    vocab = spark.range(TERMS).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("term"))
    out = np.zeros((model.k, TERMS))
    for r in tp.topic_terms(model, vocab).collect():
        out[r["topic"] - 1, int(r["term"])] = r["beta"]
    return out


def test_each_pass_raises_the_objective_and_topics_are_found(spark, corpus):
    beta, vectors, _ = corpus
    models = tp.fit_topics(vectors, (2, K), max_iter=40)
    for k, model in models.items():
        assert len(model.bounds) > 3 and all(b >= a - 1e-9 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
        assert topics_of(spark, model).sum(axis=1) == pytest.approx(np.ones(k))
    found = topics_of(spark, models[K])
    order = [int(np.argmax(found[:, t])) for t in range(K)]
    assert sorted(order) == [0, 1, 2]
    assert np.abs(found[order] - beta).sum(axis=1).max() < 0.25
    assert models[K].bounds[-1] > models[2].bounds[-1]


def test_every_document_counts_in_every_pass(spark, corpus):
    _, vectors, rows = corpus
    fit = va.fit(vectors, (K,), max_iter=1)
    tokens = sum(sum(r[2]) for r in rows)
    stats = fit.docs().groupBy("document").agg(F.sum("gamma").alias("s")).collect()
    assert len(stats) == len(rows) and all(r["s"] == pytest.approx(1) for r in stats)
    counted = fit.slices.select(F.explode("docs").alias("d")).select(F.explode("d.n").alias("n")).agg(F.sum("n")).head()[0]
    assert counted == tokens


def test_same_start_on_any_partitioning(spark, corpus):
    _, vectors, _ = corpus
    starts = []
    for df in (vectors, vectors.repartition(13), vectors.orderBy(F.desc("document")).coalesce(1)):
        slices = va.packed(df)
        place, profiles = va.anchors(va.cooccurrence(slices, 8), 8)
        starts.append((place.tolist(), profiles))
    assert starts[0][0] == starts[1][0] == starts[2][0]
    assert np.allclose(starts[0][1], starts[1][1]) and np.allclose(starts[0][1], starts[2][1])


def test_planted_anchors_come_first(spark, corpus):
    _, vectors, _ = corpus
    place, _ = va.anchors(va.cooccurrence(va.packed(vectors), 8), K)
    assert sorted(place.tolist()) == [0, 1, 2]


def test_many_blocks_and_slices(spark, corpus, monkeypatch):
    """Terms of the same corpus spread over 42 blocks, documents over dozens of slices, added two at a time."""
    _, vectors, _ = corpus
    wide = vectors.withColumn("idx", F.transform("idx", lambda i: i * 717))
    monkeypatch.setattr(va, "FAN", 2)
    monkeypatch.setattr(va, "SLICE_CELLS", 200)
    fit = va.fit(wide, (K,), max_iter=25)
    assert fit.slices.count() > 20 and fit.blocks.count() == 42
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(fit.bounds[K], fit.bounds[K][1:]))
    vocab = spark.range(TERMS).select((F.col("id") * 717).alias("idx"), F.col("id").cast("string").alias("term"))
    assert [r["s"] for r in fit.terms(vocab).groupBy("topic").agg(F.sum("beta").alias("s")).collect()] == pytest.approx([1.0] * K)
    monkeypatch.undo()
    assert fit.bounds[K][-1] == pytest.approx(va.fit(vectors, (K,), max_iter=25).bounds[K][-1], rel=5e-3)


def test_year_moves_the_prior(spark):
    _, rows = planted(400, seed=3, year_effect=0.8)
    df = spark.createDataFrame(rows, SCHEMA)
    models = tp.fit_topics(df.select("document", "idx", "n"), (K,), max_iter=30, covariates=df.select("document", "year", "month"))
    model = models[K]
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    planted_topic = int(np.argmax(topics_of(spark, model)[:, 0]))
    year, month = model.effects[1], model.effects[2]
    others = [t for t in range(K) if t != planted_topic]
    # 0.8 a year, and a year is a standard deviation of 1.41; positions are shrunk towards the mean
    assert 0.7 < year[planted_topic] - np.mean(year[others]) < 1.5
    assert np.abs(month - month.mean()).max() < 0.3


def test_without_covariates_a_constant_one_changes_nothing(spark, corpus):
    _, vectors, _ = corpus
    constant = vectors.select("document", F.lit(7).alias("year"))
    plain, same = (va.fit(vectors, (K,), max_iter=3, covariates=c).bounds[K] for c in (None, constant))
    assert plain == pytest.approx(same, rel=1e-9)


def test_new_documents_are_placed_like_fitted_ones(spark, corpus):
    _, vectors, _ = corpus
    models = tp.fit_topics(vectors, (2, K), max_iter=60)
    fitted = {(r["K"], r["document"], r["topic"]): r["gamma"] for r in tp.every_topic_docs(models).collect()}
    placed = tp.every_topic_docs(models, vectors).collect()
    assert len(placed) == len(fitted) == 240 * 5
    assert max(abs(r["gamma"] - fitted[r["K"], r["document"], r["topic"]]) for r in placed) < 0.02


def test_small_and_odd_corpora(spark):
    one = spark.createDataFrame([("a", [0, 1], [2.0, 1.0]), ("b", [], []), ("c", [1], [1.0]), (None, [0], [5.0])], "document string, idx array<long>, n array<double>")
    models = tp.fit_topics(one, (2, 5), max_iter=5)
    docs = tp.every_topic_docs(models).groupBy("K", "document").agg(F.sum("gamma").alias("s")).collect()
    assert len(docs) == 6 and all(r["s"] == pytest.approx(1) for r in docs)
    none = tp.fit_topics(one.limit(0), (2,), max_iter=5)
    assert none[2].bounds == [] and tp.every_topic_docs(none).count() == 0


def test_passes_leave_documents_where_they_are(spark, corpus, monkeypatch):
    """Only the start is written by slice; a pass writes topics, and sums of a partition's slices come as one table for each block."""
    _, vectors, _ = corpus
    staged, parts = [], []
    stage, added = va._stage, va.added
    monkeypatch.setattr(va, "_stage", lambda df: staged.append(df) or stage(df))
    monkeypatch.setattr(va, "added", lambda df, *more: parts.append(df.count()) or added(df, *more))
    monkeypatch.setattr(va, "SLICE_CELLS", 400)
    fit = va.fit(vectors, (K,), max_iter=3)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fit.slices.count() > usual and len(staged) == 1
    assert all(n <= max(usual, -(-fit.slices.count() // va.TOGETHER)) for n in parts[2:])


def test_documents_travel_as_one_row_of_bytes(spark):
    rows = [([4, 9, 30], [1.0, 2.0, 5.0], [1.0, 0.5]), ([9, 4, 9], [1.0, 3.0, 2.0], [1.0, -1.0]), ([7, 30], [0.0, 4.0], [1.0, 0.0])]
    kind = pa.struct([("idx", pa.list_(pa.int64())), ("n", pa.list_(pa.float64())), ("x", pa.list_(pa.float64()))])
    docs = pa.array([{"idx": i, "n": n, "x": x} for i, n, x in rows], kind)
    whole = va.Slice(docs)
    for own in (whole, va.Slice.of(pa.py_buffer(whole.payload()))):
        assert own.terms.tolist() == [4, 7, 9, 30] and own.x.tolist() == [r[2] for r in rows]
        (a, b, counts), = own.chunks()
        # repeated places are added, empty ones are no cells, and memory that is used again keeps nothing
        for factor in (1, 2):
            assert counts.spread(counts.n * factor).tolist() == (factor * np.array([[1, 0, 2, 5], [3, 0, 3, 0], [0, 0, 0, 4]])).tolist()
        assert (a, b, len(counts.n)) == (0, 3, 6)


def test_texts_are_taken_apart_once_for_the_trimmed_terms(spark):
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(d, f"t{w}", 1 + (d + w) % 3) for d in range(40) for w in range(6) if w < 2 or d == w]
    terms = spark.createDataFrame(rows, "document long, term string, n long").repartition(3).mapInArrow(counting, "document long, term string, n long")
    kept = {(r["document"], r["term"], r["n"]) for r in _trimmed(SimpleNamespace(subtitle_terms=terms)).collect()}
    assert kept == {r for r in rows if r[1] in ("t0", "t1")}
    assert read.value == len(rows)


def test_documents_written_before_the_last_passes_are_deleted(spark, corpus):
    import glob
    import time

    tp.fit_topics(corpus[1], (2,), max_iter=1)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    tp.fit_topics(corpus[1], (2,), max_iter=6 * va.KEPT + 1, tolerance=-1.0)
    for _ in range(50):  # Spark deletes them beside the work
        left = len(set(glob.glob(f"{folder}/rdd-*")) - before)
        if left <= 3:
            break
        time.sleep(0.1)
    assert left <= 3  # of six
