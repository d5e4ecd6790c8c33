import math
import re

import pytest
from pyspark.sql import functions as F

from forumgauge.operators import relate
from forumgauge.operators import terms as dt
from forumgauge.operators import topics as tp
from forumgauge.plans.topics import compare_topic_numbers, prepare, topics_and_toxicity
from forumgauge.session import written


@pytest.fixture(scope="module")
def corpus(spark, table):
    texts = table("conversations").select(F.col("conv_id").alias("document"), "text")
    return prepare(texts, ["the", "of"], sparsity=0.9)


@pytest.fixture(scope="module")
def models(corpus):
    return tp.fit_topics(corpus.vectors, ks=(3,), max_iter=10)


def test_model_tables_are_distributions(corpus, models):
    beta, gamma = tp.topic_terms(models[3], corpus.vocab), tp.topic_docs(models[3], corpus.vectors)
    for key, df, value in (("topic", beta, "beta"), ("document", gamma, "gamma")):
        for r in df.groupBy(key).agg(F.sum(value).alias("s")).collect():
            assert r["s"] == pytest.approx(1.0, abs=1e-6)
    assert {r["topic"] for r in beta.select("topic").distinct().collect()} == {1, 2, 3}
    assert beta.count() == 3 * corpus.vocab.count()


def test_same_seed_same_model(corpus, models):
    again = tp.fit_topics(corpus.vectors, ks=(3,), max_iter=10)
    rows = lambda m: sorted(tuple(r) for r in tp.topic_terms(m, corpus.vocab).withColumn("beta", F.round("beta", 6)).collect())
    assert rows(models[3]) == rows(again[3])


def test_vectors_round_trip(spark, corpus):
    back = dt.from_sparse_vectors(dt.to_sparse_vectors(corpus.training, corpus.vocab), corpus.vocab)
    key = lambda df: sorted(tuple(r) for r in df.select("document", "term", "n").collect())
    assert key(back) == key(corpus.training)


def test_trimming(spark):
    counts = spark.createDataFrame([(d, t, 1) for d in range(10) for t in (["all"] + (["few"] if d < 2 else []))],
                                   "document int, term string, n int")
    assert {r["term"] for r in dt.trim_terms(counts, 0.7).collect()} == {"all"}
    assert {r["term"] for r in dt.trim_terms(counts, 0.8).collect()} == {"all", "few"}


def test_tf_idf(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("b", "x", 1)], "document string, term string, n int")
    rows = {(r["document"], r["term"]): r["tf_idf"] for r in dt.tf_idf(counts, top=None).collect()}
    assert rows["a", "y"] == pytest.approx(0.5 * math.log(2)) and rows["b", "x"] == 0.0
    assert dt.tf_idf(counts, top=1).count() == 2


def test_top_terms_keep_order_and_ties(spark):
    beta = spark.createDataFrame([(1, "b", .4), (1, "a", .4), (1, "c", .2)], "topic int, term string, beta double")
    assert tp.top_terms(beta, 1).first()["terms"] == "a, b"


def test_coherence_by_hand(spark):
    beta = spark.createDataFrame([(1, "a", .5), (1, "b", .3), (1, "c", .2)], "topic int, term string, beta double")
    docs = {1: "ab", 2: "abc", 3: "a", 4: "c"}
    counts = spark.createDataFrame([(d, t, 1) for d, ts in docs.items() for t in ts], "document int, term string, n int")
    want = math.log(3 / 3) + math.log(2 / 3) + math.log(2 / 2)  # ba, ca, cb
    assert tp.semantic_coherence(beta, counts, 3).first()["semantic_coherence"] == pytest.approx(want)
    assert tp.semantic_coherence(beta, counts, 10).first()["semantic_coherence"] == pytest.approx(want)


def test_coherence_beyond_one_mask(spark):
    beta = spark.createDataFrame([(1, f"t{i:03}", 1 / (i + 2)) for i in range(70)], "topic int, term string, beta double")
    counts = spark.createDataFrame([(d, f"t{i:03}", 1) for d in range(6) for i in range(70) if d == 0 or i % (d + 1) == 0], "document int, term string, n int")
    held = {f"t{i:03}": {d for d in range(6) if d == 0 or i % (d + 1) == 0} for i in range(70)}
    names = sorted(held)
    want = sum(math.log((len(held[a] & held[b]) + 1) / len(held[b])) for i, a in enumerate(names) for b in names[:i])
    assert tp.semantic_coherence(beta, counts, 70).first()["semantic_coherence"] == pytest.approx(want)


def test_coherence_of_many_topics_by_hand(spark):
    # 90 leading terms, shared by topics; a missing term, a row that is there twice, documents with several rows of a term
    lead = {t: [f"t{(7 * t + 3 * i) % 90:02}" for i in range(30)] for t in range(1, 7)}
    rows = [(t, w, 1 / (i + 2)) for t, ws in lead.items() for i, w in enumerate(ws)] + [(7, None, .6), (7, "t01", .4), (8, "t05", .5), (8, "t05", .5)]
    beta = spark.createDataFrame(rows, "topic int, term string, beta double")
    held = {f"t{i:02}": {d for d in range(40) if (i * d) % 5 < 2 or d % 9 == i % 9} for i in range(90)}
    cells = [(d, w, 1) for w, ds in held.items() for d in ds for _ in range(1 + d % 2)] + [(50, "other", 1)]
    counts = spark.createDataFrame(cells, "document int, term string, n int")
    got = {r["topic"]: r["semantic_coherence"] for r in tp.semantic_coherence(beta, counts, 30).collect()}
    for t, ws in lead.items():
        want = sum(math.log((len(held[a] & held[b]) + 1) / len(held[b])) for i, a in enumerate(ws) for b in ws[:i])
        assert got[t] == pytest.approx(want)
    assert got[7] is None and got[8] == pytest.approx(math.log((len(held["t05"]) + 1) / len(held["t05"])))


def test_coherence_drops_terms_first_and_multiplies_no_document(spark):
    beta = spark.createDataFrame([(t, f"t{i}", 1 / (i + 2)) for t in range(5) for i in range(5)], "topic int, term string, beta double")
    tokens = spark.range(200).repartition(4).select(F.col("id").alias("document"), F.explode(F.array(*[F.concat(F.lit("t"), (F.col("id") * j % 50).cast("string")) for j in range(8)])).alias("term"))
    plan = tp.semantic_coherence(beta, dt.doc_term_counts(tokens), 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(document#\d+L?, topic#", plan)
    # the leading terms meet the tokens below (later in the tree than) the shuffle of their counts
    assert re.search(r"hashpartitioning\(document#\d+L?, term#", plan).start() < plan.index("LeftSemi")


def test_exclusivity_by_hand(spark):
    values = {(t, f"w{i}"): ((i * 7 + t * 11) % 13 + 1) / 100 if i % 4 != t else 0.01 * (i % 3 + 1) for t in range(1, 5) for i in range(60) if (i + t) % 6}
    beta = spark.createDataFrame([(t, w, v) for (t, w), v in values.items()], "topic int, term string, beta double")
    sums = {}
    for (_, w), v in values.items():
        sums[w] = sums.get(w, 0) + v
    got = {r["topic"]: r["exclusivity"] for r in tp.exclusivity(beta).collect()}
    for t in range(1, 5):
        own = {w: (v, round(v / sums[w], 12)) for (u, w), v in values.items() if u == t}
        share = lambda i, x: sum(r[i] <= x for r in own.values()) / len(own)
        lead = sorted(own, key=lambda w: (-own[w][0], w))[:10]
        assert got[t] == pytest.approx(sum(1 / (0.7 / share(1, own[w][1]) + 0.3 / share(0, own[w][0])) for w in lead))


def test_heldout_tokens_without_a_model_are_counted(spark):
    beta = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "topic int, term string, beta double")
    gamma = spark.createDataFrame([("d", 1, 1.0), ("e", 1, 1.0)], "document string, topic int, gamma double")
    held = spark.createDataFrame([("d", "a", 2), ("d", "new", 3), ("e", "new", 4), ("f", "a", 5)], "document string, term string, n int")
    got = tp.heldout_likelihood(held, gamma, beta).first()
    assert got[0] == pytest.approx(math.log(0.5)) and (got[1], got[2]) == (2, 12)


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_dispersion_by_hand(spark, block):
    beta = spark.createDataFrame([(1, "a", .5), (1, "b", .3), (1, "c", .2), (2, "a", .1), (2, "b", .1), (2, "c", .8)],
                                 "topic int, term string, beta double")
    mix = {1: (0.25, 0.75), 2: (1.0, 0.0), 3: (0.5, 0.5), 4: (0.1, 0.9)}
    gamma = spark.createDataFrame([(d, k + 1, g) for d, gs in mix.items() for k, g in enumerate(gs)], "document int, topic int, gamma double")
    cells = {1: {"a": 4, "c": 1}, 2: {"a": 1, "b": 2}, 3: {"b": 5}, 4: {"c": 9, "a": 2}}
    counts = spark.createDataFrame([(d, t, n) for d, c in cells.items() for t, n in c.items()], "document int, term string, n int")
    weights = {"a": (.5, .1), "b": (.3, .1), "c": (.2, .8)}
    total = used = 0.0
    for d, gs in mix.items():
        m = sum(cells[d].values())
        for t, bs in weights.items():
            q = sum(g * b for g, b in zip(gs, bs))
            total += (cells[d].get(t, 0) - m * q) ** 2 / (m * q * (1 - q))
            used += m * q > 0.01
    got = tp.residual_dispersion(counts, gamma, beta, block=block).first()[0]
    assert got == pytest.approx(total / (used - 3 - 4 * 1))


def test_heldout_split_is_complete_and_repeatable(corpus):
    training, heldout = tp.heldout_split(corpus.training, 0.5)
    assert training.count() + heldout.count() == corpus.training.count()
    assert training.join(heldout, ["document", "term"]).count() == 0


def shares_and_gamma(spark, k=3, documents=60):
    rows, share = [], []
    for d in range(documents):
        raw = [1 + (d * (7 + 4 * t) + t) % 11 for t in range(k)]
        rows += [(f"v{d}", t + 1, raw[t] / sum(raw)) for t in range(k)]
        share.append((f"v{d}", None, 5 + 20 * raw[0] / sum(raw) + (d % 3) * 0.1))
    return (spark.createDataFrame(rows, "document string, topic int, gamma double"),
            spark.createDataFrame(share, "video_id string, date date, prop_offense double"))


def test_regression_drops_the_collinear_topic(spark):
    gamma, shares = shares_and_gamma(spark)
    terms = spark.createDataFrame([(1, "a, b")], "topic int, terms string")
    rows = {r["term"]: r for r in relate.topic_regression(gamma, shares, 3, terms).collect()}
    assert rows["t_3"]["estimate"] is None and rows["t_1"]["terms"] == "a, b"
    assert rows["t_1"]["estimate"] == pytest.approx(20, abs=0.5) and rows["t_1"]["p_value"] < 0.001
    assert rows["(Intercept)"]["topic"] is None and math.isfinite(rows["t_2"]["p_value"])


def test_one_predictor_agrees_with_the_closed_form(spark):
    gamma, shares = shares_and_gamma(spark, k=2)
    terms = spark.createDataFrame([], "topic int, terms string")
    model = {r["topic"]: r for r in relate.topic_regression(gamma, shares, 2, terms).collect()}
    single = {r["topic"]: r for r in relate.topic_regression_single(gamma, shares).collect()}
    assert model[1]["estimate"] == pytest.approx(single[1]["estimate"])


def test_significance(spark):
    table = spark.createDataFrame([("(Intercept)", 1., .0, None), ("t_1", 2., .001, 1), ("t_2", -3., .0001, 2), ("t_3", None, None, 3)],
                                  "term string, estimate double, p_value double, topic int")
    assert [r["topic"] for r in relate.significant_topics(table).collect()] == [1, 2]
    assert [r["topic"] for r in relate.significant_topics(table, strict=True).collect()] == [2]
    assert relate.significant_topics(table, strict=True, positive=True).count() == 0


def test_episode_topics_from_text_to_regression(spark, corpus):
    models, table = compare_topic_numbers(corpus, ks=(3,), max_iter=5)
    assert {r["metric"] for r in table.collect()} == {
        "exclusivity", "lower_bound", "residuals", "semantic_coherence", "heldout_likelihood"}
    assert all(math.isfinite(r["value"]) for r in table.collect())
    episodes = corpus.vectors.select(F.col("document").alias("video_id"), F.lit("2024-01-01").cast("date").alias("date"))
    # planted: the more of the first topic, the more offense
    first = tp.topic_docs(models[3]).where("topic = 1").select(F.col("document").alias("video_id"), "gamma")
    shares = episodes.join(first, "video_id").withColumn("prop_offense", 100 * F.col("gamma") + F.col("video_id") * 37 % 11).drop("gamma")
    coefficients, found = topics_and_toxicity(models[3], corpus, episodes, shares, alpha=2.0)
    assert coefficients.count() == 4
    assert {r["term"]: r["estimate"] for r in coefficients.collect()}["t_1"] > 0
    assert found.count() > 0


def test_heldout_likelihood_uses_the_whole_model(spark, folder):
    import __spark_entry__ as entry
    from forumgauge.catalog.tables import Tables

    queries, tables = entry.queries(), Tables(spark, folder)
    held = tp.heldout_split(tables.source_terms)[1].agg(F.sum("n")).head()[0]
    whole = queries["heldout_likelihood"](spark, folder).head()
    assert (whole.tokens_used, whole.tokens_skipped) == (held, 0)
    trained = queries["heldout_likelihood_of_training"](spark, folder).head()
    assert trained.tokens_used + trained.tokens_skipped == held and 0 < trained.tokens_skipped


def plain_counts(rows, stop, sparsity, lemmas=None):
    """Counts by document of words, without stop words and numbers, of lemmas, of terms in a share of the documents."""
    n = {}
    for d, text in rows:
        for w in re.findall(r"\w+", (text or "").lower()):
            if w not in stop and not w.isdigit():
                for lemma in (lemmas or {}).get(w, [w]):
                    n[d, lemma] = n.get((d, lemma), 0) + 1
    documents = len({d for d, _ in n} - {None})
    df = {t: sum(1 for _, u in n if u == t) for _, t in n}
    return {k: v for k, v in n.items() if df[k[1]] >= (1 - sparsity) * documents}


@pytest.mark.parametrize("lemmas", [None, {"cats": ["cat"], "dogs": ["dog", "pet"], "rare2": ["rare"]}])
def test_words_that_can_not_pass_are_dropped_before_they_are_counted(spark, monkeypatch, lemmas):
    tables = {}
    monkeypatch.setattr(dt, "written", lambda df, label="table": tables.setdefault(label, written(df, label)))
    rows = [(i % 30, f"the cat{'s' * (i % 2)} and 12 dog{'s' * (i % 3 == 0)} often often own{i} own{i}x" + " some" * (i % 4 == 0)) for i in range(60)]
    rows += [(None, "the cat rare1"), (None, "cats rare2"), (90, None), (91, "the 12"), (92, "rare rare2"), (7, "often twice twice twice")]
    df = spark.createDataFrame(rows, "own int, body string")
    dictionary = spark.createDataFrame([(w, x) for w, xs in lemmas.items() for x in xs], "word string, lemma string") if lemmas else None
    got = prepare(df, ["the", "and"], dictionary, sparsity=0.7, document="own", text="body")
    cells = {(r["document"], r["term"]): r["n"] for r in got.training.unionByName(got.heldout).collect()}
    want = plain_counts(rows, {"the", "and"}, 0.7, lemmas)
    assert cells == want and len(want) > 60
    held = {r["term"] for r in tables["counts"].select("term").distinct().collect()}
    assert held >= {t for _, t in want} and not any(t.startswith(("own", "rare")) for t in held)


def test_several_models_are_judged_in_one_scan(spark):
    topics = {2: {1: {"a": .5, "b": .3, "c": .2}, 2: {"a": .1, "b": .1, "c": .8}}, 1: {1: {"a": .2, "b": .5, "c": .3}}}
    shares = {2: {1: (.3, .7), 2: (.6, .4), 3: (.5, .5)}, 1: {1: (1.,), 2: (1.,), 3: (1.,)}}
    counts = spark.createDataFrame([(1, "a", 3), (1, "c", 4), (2, "b", 5), (2, "zz", 1), (3, "a", 1), (4, "a", 2), (None, "a", 1)], "document int, term string, n int")
    beta = spark.createDataFrame([(k, t, w, v) for k, ts in topics.items() for t, ws in ts.items() for w, v in ws.items()], "K int, topic int, term string, beta double")
    mixed = spark.createDataFrame([(d, [*shares[1][d], *shares[2][d]]) for d in (1, 2, 3)], "document int, values array<double>")
    dispersion = {r["K"]: r["residual_dispersion"] for r in tp.residual_dispersion(counts, mixed, beta).collect()}
    likelihood = {r["K"]: tuple(r)[1:] for r in tp.heldout_likelihood(counts, mixed, beta).collect()}
    for k in topics:
        gamma = spark.createDataFrame([(d, i + 1, g) for d, gs in shares[k].items() for i, g in enumerate(gs)], "document int, topic int, gamma double")
        alone = beta.where(F.col("K") == k).drop("K")
        assert dispersion[k] == pytest.approx(tp.residual_dispersion(counts, gamma, alone).first()[0])
        assert likelihood[k] == pytest.approx(tuple(tp.heldout_likelihood(counts, gamma, alone).first()))
    assert tp.residual_dispersion(counts, mixed, beta.limit(0)).count() == tp.heldout_likelihood(counts, mixed, beta.limit(0)).count() == 0
