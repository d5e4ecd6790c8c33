"""Topic models, their tidy tables and their diagnostics.

``beta`` is ``(topic, term, beta)``, ``gamma`` is ``(document, topic, gamma)``; topics
count from 1. The diagnostics take these tables, so they work on any model.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import first_rows, join_null_safe, single
from ..session import swept, written
from . import variational
from .reshape import pivot_longer
from .windows import top_n_per_group

TOPIC_NUMBERS = (10, 15, 20, 25, 30)
#: Leading terms per mask of ``semantic_coherence``.
MASK = 62


@dataclass(frozen=True)
class TopicModel:
    """One model of a fit; the tables of models fitted together are shared."""

    k: int
    fit: variational.Fit

    @property
    def bounds(self) -> list[float]:
        """The joint objective after each pass."""
        return self.fit.bounds[self.k]

    @property
    def effects(self) -> np.ndarray:
        """Prior means: a row for the level and one for each covariate, a column for each topic."""
        return self.fit.effects[self.k]


def fit_topics(
    vectors: DataFrame, ks: Sequence[int] = TOPIC_NUMBERS, max_iter: int = 200, tolerance: float = 1e-5,
    covariates: DataFrame | None = None, key: str = "document",
) -> dict[int, TopicModel]:
    """One model per number of topics, fitted side by side: each pass reads every document once for all of them.

    The start is spectral (anchor terms), so a fit has no seed. Passes end when no model's objective grows by more
    than ``tolerance`` of itself, or after ``max_iter``. ``covariates`` (``key`` and figures such as year and month)
    move the prior mean of a document's proportions and are fitted in every pass. Nothing of the size of
    the vocabulary or of the documents is held in one place.
    """
    fit = variational.fit(vectors, ks, max_iter, tolerance, covariates=covariates, key=key)
    return {k: TopicModel(k, fit) for k in ks}


def every_topic_terms(models: Mapping[int, TopicModel], vocab: DataFrame) -> DataFrame:
    """``(K, topic, term, beta)`` of models fitted together, in one scan."""
    return next(iter(models.values())).fit.terms(vocab)


def every_topic_docs(models: Mapping[int, TopicModel], vectors: DataFrame | None = None) -> DataFrame:
    """``(K, document, topic, gamma)`` of models fitted together, in one scan: of the fitted documents, or of others."""
    fit = next(iter(models.values())).fit
    return fit.docs() if vectors is None else fit.infer(vectors)


def every_topic_mixtures(models: Mapping[int, TopicModel]) -> DataFrame:
    """``(document, values)``: the proportions of the fitted documents for all models in one array, by K and topic."""
    return next(iter(models.values())).fit.mixtures()


def topic_terms(model: TopicModel, vocab: DataFrame) -> DataFrame:
    """``(topic, term, beta)`` with every term of the vocabulary in every topic."""
    return model.fit.terms(vocab).where(F.col("K") == model.k).select("topic", "term", "beta")


def topic_docs(model: TopicModel, vectors: DataFrame | None = None, document: str = "document") -> DataFrame:
    """``(document, topic, gamma)`` of the fitted documents, or of any ``vectors`` with terms of the same vocabulary."""
    if vectors is not None and document != "document":
        vectors = vectors.withColumnRenamed(document, "document")
    return every_topic_docs({model.k: model}, vectors).where(F.col("K") == model.k).select("document", "topic", "gamma")


def top_terms(beta: DataFrame, n: int = 10, output: str = "terms") -> DataFrame:
    """The ``n`` most probable terms of each topic as "a, b, c", most probable first."""
    best = top_n_per_group(beta, "beta", n, ["topic"])
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("beta")).alias("b"), "term")))
    return best.groupBy("topic").agg(
        F.array_join(F.transform(ordered, lambda c: c["term"]), ", ").alias(output)
    )


def _leading(beta: DataFrame, m: int) -> DataFrame:
    """Exactly ``m`` terms per topic with their rank from 1.

    Terms are dealt to more parts than there are places; the ``m``-th of a topic's best of each part is no better than its
    ``m``-th term, so only the few rows that reach it are sorted.
    """
    parts = beta.groupBy("topic", F.pmod(F.xxhash64("term"), F.lit(16 * m)).alias("part")).agg(F.max("beta").alias("top"))
    cut = parts.groupBy("topic").agg(F.get(F.sort_array(F.collect_list("top"), asc=False), m - 1).alias("__cut"))
    near = join_null_safe(beta, written(cut, "cuts"), ["topic"], "inner")
    near = near.where(F.col("__cut").isNull() | (F.col("beta") >= F.col("__cut"))).drop("__cut")
    return first_rows(near, ["topic"], [F.desc("beta"), F.col("term")], m, "rank")


def semantic_coherence(beta: DataFrame, counts: DataFrame, m: int = 10) -> DataFrame:
    """Sum over pairs of leading terms of ln((documents with both + 1) / documents with
    the more probable one), per topic.

    Each document contributes one row of bits, one for each term that leads any topic (several words beyond 62 terms).
    The bit mask of a topic's leading terms is read off that row where it stands; documents with the same mask
    are counted together, and pairs are read off the masks, so neither topics nor pairs multiply what is shuffled.
    """
    return _coherence(written(_leading(beta, m).select("topic", "term", "rank"), "leading"), counts, m)


def _coherence(leading: DataFrame, counts: DataFrame, m: int) -> DataFrame:
    """``semantic_coherence`` of ``leading`` terms (``topic, term, rank``)."""
    # at most m terms per topic, so one task numbers them
    terms = leading.where(F.col("term").isNotNull()).select("term").distinct()
    places = written(terms.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place")), "places")
    where = [F.floor(F.col("place") / MASK).cast("int"), (F.col("place") % MASK).cast("int")]
    lists = F.sort_array(F.collect_list(F.struct("rank", where[0].alias("word"), where[1].alias("bit"))))
    each = written(leading.join(places, "term", "left").groupBy("topic").agg(lists["word"].alias("word"), lists["bit"].alias("bit")), "places")
    wide = range(max(1, -(-places.count() // MASK)))
    # other terms are dropped before the counts are shuffled, if they are not counted yet
    cells = counts.select("document", "term").join(places.select("term"), "term", "left_semi").join(places, "term").select("document", where[0].alias("word"), where[1].alias("bit"))
    # cells of a document come from everywhere, so they are moved as they are, not as rows of all bits
    cells = cells.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document")
    one_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    held = cells.groupBy("document").agg(*[F.bit_or(F.when(F.col("word") == w, one_bit).otherwise(0)).alias(f"w{w}") for w in wide])

    def own(r):
        found = F.call_function("shiftright", F.get("held", F.get("word", r)), F.get("bit", r)).bitwiseAND(F.lit(1).cast("bigint"))
        return F.call_function("shiftleft", F.coalesce(found, F.lit(0).cast("bigint")), F.lit(r % MASK))

    either = lambda x, y: x.bitwiseOR(y)
    parts = [f"m{p}" for p in range(-(-m // MASK))]
    words = [reduce(either, [own(r) for r in range(p * MASK, min(m, (p + 1) * MASK))]).alias(name) for p, name in enumerate(parts)]
    present = held.select(F.array(*[f"w{w}" for w in wide]).alias("held")).crossJoin(each).select("topic", *words)
    masks = present.groupBy("topic", *parts).agg(F.count("*").alias("n"))
    masks = masks.select("topic", F.array(*parts).alias("mask"), "n")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(2, m + 1) for j in range(1, i)
    ])).alias("pair")
    def has(r):
        place = F.col(f"pair.{r}") - 1
        word = F.get("mask", F.floor(place / MASK).cast("int"))
        return F.call_function("shiftright", word, place % MASK).bitwiseAND(F.lit(1)) == 1

    spread = masks.select("topic", "mask", "n", pairs)
    both = F.sum(F.when(has("i") & has("j"), F.col("n")).otherwise(0))
    one = F.sum(F.when(has("j"), F.col("n")).otherwise(0))
    per_pair = spread.groupBy("topic", "pair").agg(both.alias("both"), one.alias("one"))
    # pairs beyond a topic's vocabulary have no documents and no ratio
    score = F.ln(F.try_divide(F.col("both") + 1, F.col("one")))
    sized = leading.groupBy("topic").agg(F.max("rank").alias("last"))
    scored = (
        per_pair.join(sized, "topic").where(F.col("pair.i") <= F.col("last"))
        .groupBy("topic").agg(F.sum(score).alias("semantic_coherence"))
    )
    return sized.select("topic").join(scored, "topic", "left")  # no leading term in any document: null


def _rated(beta: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``beta`` with ``excl``, a topic's share of the term's sum over topics; a window holds a term's rows, at most one for each topic.

    The hash comes first because numbers are sorted faster than words.
    """
    # rounded, so that equal ratios stay equal whatever the order of summation
    share = F.try_divide("beta", F.sum("beta").over(Window.partitionBy(F.xxhash64("term"), "term", *within)))
    return written(beta.withColumn("excl", F.round(share, 12)), "rated")


def exclusivity(beta: DataFrame, m: int = 10, weight: float = 0.7) -> DataFrame:
    """Sum over the leading terms of the weighted harmonic mean of two ranks: how
    exclusive the term is to the topic, and how frequent it is in the topic.

    A rank is the share of the topic's terms with at most that value. Only the ranks of
    the leading terms matter, so terms are counted between the leading terms' values
    instead of being sorted.
    """
    rated = _rated(beta)
    # m rows per topic that three plans read; finding them is a pass over the whole table
    return _exclusive(rated, written(_leading(rated, m).select("topic", "term", "beta", "excl"), "leading"), m, weight)


def _exclusive(rated: DataFrame, leading: DataFrame, m: int, weight: float = 0.7) -> DataFrame:
    """``exclusivity`` of ``leading`` terms (``topic, term, beta, excl``) among all ``rated`` ones."""
    marks = leading.groupBy("topic").agg(F.collect_list("beta").alias("by_beta"), F.collect_list("excl").alias("by_excl"))
    above = lambda marks_, v: F.size(F.filter(marks_, lambda t: t >= v))
    # nearly all terms are below or above all marks, which two comparisons tell
    ends = {f"{f.__name__}_{c}": f(f"by_{c}") for c in ("beta", "excl") for f in (F.array_min, F.array_max)}
    at = lambda c: (
        F.when(F.col(c) <= F.col(f"array_min_{c}"), F.size(f"by_{c}")).when(F.col(c) > F.col(f"array_max_{c}"), 0).otherwise(above(F.col(f"by_{c}"), F.col(c))))
    # one small row per topic, which each task holds
    placed = rated.join(marks.withColumns(ends), "topic").select("topic", at("beta").alias("beta_at"), at("excl").alias("excl_at"))
    between = placed.groupBy("topic", "beta_at", "excl_at").agg(F.count("*").alias("n"))
    own = leading.join(marks, "topic").select(
        "topic", "term",
        above(F.col("by_beta"), F.col("beta")).alias("own_beta"), above(F.col("by_excl"), F.col("excl")).alias("own_excl"),
    )
    counted = own.join(between, "topic").groupBy("topic", "term").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("beta_at") >= F.col("own_beta"), F.col("n"))).alias("up_beta"),
        F.sum(F.when(F.col("excl_at") >= F.col("own_excl"), F.col("n"))).alias("up_excl"),
    )
    frex = 1 / (F.lit(weight) / (F.col("up_excl") / F.col("all")) + F.lit(1 - weight) / (F.col("up_beta") / F.col("all")))
    return counted.groupBy("topic").agg(F.sum(frex).alias("exclusivity"))


def heldout_split(counts: DataFrame, share: float = 0.25, seed: int = 42):
    """``(training, held out)``: cells of the document-term table by a repeatable hash.
    Split before fitting."""
    key = F.concat_ws("-", F.lit(str(seed)), F.col("document").cast("string"), "term")
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return counts.where(u >= share), counts.where(u < share)


def _models_of(beta: DataFrame) -> list[tuple]:
    """``(K, topics)`` of each model in a table of topics; K is None in a table of one model without that column."""
    if "K" not in beta.columns:
        return [(None, [r[0] for r in beta.select("topic").distinct().orderBy("topic").collect()])]  # one row per topic
    held: dict = {}
    for k, topic in beta.select("K", "topic").distinct().orderBy("K", "topic").collect():
        held.setdefault(k, []).append(topic)
    return list(held.items())


def _by_topic(df: DataFrame, key: str, value: str, models: Sequence[tuple]) -> DataFrame:
    """``(key, values)``: the values in the order of the topics of all models, 0 where there is none; a table that has ``values`` is such a one."""
    if "values" in df.columns:
        return df.select(key, "values")
    name = F.struct("K", "topic") if "K" in df.columns else F.col("topic")
    held = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name.alias("name"), value))).alias("values"))
    each = F.array(*[F.lit(t) if k is None else F.struct(F.lit(k).alias("K"), F.lit(t).alias("topic")) for k, topics in models for t in topics])
    return held.select(key, F.transform(each, lambda t: F.coalesce(F.try_element_at("values", t), F.lit(0.0))).alias("values"))


def _parts_of(models: Sequence[tuple]) -> list[tuple[int, int]]:
    """Where each model's topics begin in ``values``, and how many they are."""
    ends = np.cumsum([len(topics) for _, topics in models]).tolist()
    return [(end - len(topics), len(topics)) for end, (_, topics) in zip(ends, models)]


def _per_model(models: Sequence[tuple], row: DataFrame, **figures: Sequence) -> DataFrame:
    """One row of figures (a list of them for each model) as a row for each model, named by K if the models are."""
    if models[0][0] is None:
        return row.select(*[f[0].alias(n) for n, f in figures.items()])
    rows = [F.struct(F.lit(k).alias("K"), *[f[i].alias(n) for n, f in figures.items()]) for i, (k, _) in enumerate(models)]
    return row.select(F.inline(F.array(*rows)))


def _weights(terms: DataFrame) -> DataFrame:
    """A written table of terms, to be sent to the rows it is joined to if it is as small as topics that a fit sends to its slices."""
    few = variational.WHOLE * variational.BLOCK
    return F.broadcast(terms) if terms.limit(few + 1).count() <= few else terms


def _mixed(g: str, b: str, part: tuple[int, int]):
    """The sum of the products of a model's part of two arrays in the same order."""
    own = lambda c: F.slice(c, part[0] + 1, part[1])
    return F.aggregate(F.zip_with(own(g), own(b), lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _fitted(counts: DataFrame, gamma: DataFrame, beta: DataFrame, models: Sequence[tuple]) -> DataFrame:
    """``counts`` with ``q``, the modelled probabilities of the term in the document, one for each model.

    Cells meet the proportions before the topics, so that no topics travel with them.
    """
    mixture = _by_topic(gamma, "document", "gamma", models).withColumnRenamed("values", "g")
    weights = _weights(written(_by_topic(beta, "term", "beta", models).withColumnRenamed("values", "b")))
    joined = counts.select("document", "term", "n").join(mixture, "document", "left").join(weights, "term", "left")
    return joined.select("document", "term", "n", F.array(*[F.coalesce(_mixed("g", "b", p), F.lit(0.0)) for p in _parts_of(models)]).alias("q"))


def heldout_likelihood(heldout: DataFrame, gamma: DataFrame, beta: DataFrame) -> DataFrame:
    """One row: mean over documents of the log-likelihood per held-out token, and the tokens
    used and skipped. A token is skipped if the model gives it no probability: its term or
    its document is unknown to the model.

    For several models, ``beta`` has a column K and ``gamma`` is ``(document, values)`` (see ``every_topic_mixtures``):
    a row for each K, from one scan of the cells.
    """
    models = _models_of(beta)
    if not models:
        return heldout.sparkSession.createDataFrame([], "K int, heldout_likelihood double, tokens_used bigint, tokens_skipped bigint")
    many, sums = range(len(models)), []
    for i in many:
        q = F.get("q", F.lit(i))
        sums += [
            F.sum(F.when(q > 0, F.col("n") * F.ln(q))).alias(f"s{i}"),
            F.coalesce(F.sum(F.when(q > 0, F.col("n"))), F.lit(0)).alias(f"used{i}"),
            F.coalesce(F.sum(F.when(~(q > 0), F.col("n"))), F.lit(0)).alias(f"skipped{i}"),
        ]
    per_doc = _fitted(heldout, gamma, beta, models).groupBy("document").agg(*sums)
    total = per_doc.agg(*[c for i in many for c in (
        F.avg(F.try_divide(f"s{i}", f"used{i}")).alias(f"mean{i}"),
        F.coalesce(F.sum(f"used{i}"), F.lit(0)).alias(f"used{i}"), F.coalesce(F.sum(f"skipped{i}"), F.lit(0)).alias(f"skipped{i}"))])
    return _per_model(
        models, total, heldout_likelihood=[F.col(f"mean{i}") for i in many], tokens_used=[F.col(f"used{i}") for i in many],
        tokens_skipped=[F.col(f"skipped{i}") for i in many])


def _dense_cells(documents: DataFrame, terms: DataFrame, parts: Sequence[tuple[int, int]], tolerance: float, block: int) -> DataFrame:
    """One row: for each model the sum of mq / (1 - q) and the number of cells with mq above the tolerance,
    over all documents and terms (``dense0, cells0, ...``).

    A blocked matrix product: documents and terms are hashed into blocks of bounded
    size, and each pair of blocks is one group that multiplies two small matrices.
    """
    rows = max(1, -(-documents.count() // block))
    columns = max(1, -(-terms.count() // block))
    bucket = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = documents.select("m", "values", bucket("document", rows).alias("r"), every(columns).alias("c"))
    right = terms.select("values", every(rows).alias("r"), bucket("term", columns).alias("c"))
    names = [f"{name}{i}" for i in range(len(parts)) for name in ("dense", "cells")]

    def multiply(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found = [0.0, 0] * len(parts)
        if not docs.empty and not words.empty:
            theta, beta, m = np.stack(docs["values"]), np.stack(words["values"]), docs["m"].to_numpy(dtype=float)[:, None]
            for i, (a, k) in enumerate(parts):
                q = theta[:, a : a + k] @ beta[:, a : a + k].T
                mq = m * q
                ratio = np.divide(mq, 1 - q, out=np.zeros_like(mq), where=q < 1)
                found[2 * i : 2 * i + 2] = ratio.sum(), int((mq > tolerance).sum())
        return pd.DataFrame([found], columns=names)

    grouped = left.groupBy("r", "c").cogroup(right.groupBy("r", "c"))
    schema = ", ".join(f"dense{i} double, cells{i} bigint" for i in range(len(parts)))
    return grouped.applyInPandas(multiply, schema).agg(*[F.sum(n).alias(n) for n in names])


def residual_dispersion(
    counts: DataFrame, gamma: DataFrame, beta: DataFrame, tolerance: float = 0.01, block: int = 2048
) -> DataFrame:
    """One row: dispersion of the residuals, near 1 for enough topics; for several models a row for each K, as in ``heldout_likelihood``.

    Sum of (x - mq)^2 / (mq(1 - q)) over all cells, divided by (cells with mq above the
    tolerance) - terms - documents * (topics - 1). Cells with x = 0 are not stored:
    expanding the square splits the sum into a part over stored cells and a part that
    depends on a document only through its mixture and length.
    """
    models = _models_of(beta)
    if not models:
        return counts.sparkSession.createDataFrame([], "K int, residual_dispersion double")
    parts = _parts_of(models)
    # both tables enter several plans and the block counts, so they are written once
    terms = written(_by_topic(beta, "term", "beta", models))
    weights = _weights(terms)
    # a document's cells go with its proportions, which are shuffled once and not again for the cells
    known = counts.join(weights.select("term"), "term", "left_semi").groupBy("document").agg(
        F.sum("n").alias("m"), F.collect_list(F.struct("term", "n")).alias("cells"))
    documents = written(_by_topic(gamma, "document", "gamma", models).join(known, "document"))
    swept(counts.sparkSession)
    cells = documents.select("m", F.col("values").alias("g"), F.explode("cells").alias("c")).select("m", "g", "c.term", "c.n").join(weights, "term")
    cells = cells.select("n", "m", F.array(*[_mixed("g", "values", p) for p in parts]).alias("q"))
    size = lambda df: single(df.agg(F.count("*").alias("n")))
    sums, found = [], []
    for i, (_, k) in enumerate(parts):
        q = F.get("q", F.lit(i))
        mq = F.col("m") * q
        sums.append(F.sum(F.when((q > 0) & (q < 1), (F.col("n") * F.col("n") - 2 * F.col("n") * mq) / (mq * (1 - q)))).alias(f"s{i}"))
        freedom = F.col(f"cells{i}") - size(terms) - size(documents) * (k - 1)
        found.append(F.try_divide(F.col(f"dense{i}") + F.col(f"s{i}"), freedom))
    dense = _dense_cells(documents, terms, parts, tolerance, block)
    # one row of sums each
    return _per_model(models, dense.crossJoin(cells.agg(*sums)), residual_dispersion=found)


def model_bound(model: TopicModel, spark: SparkSession) -> DataFrame:
    """One row: K, the last joint objective, log K!, their sum, and the passes made."""
    bound, lfact = model.bounds[-1] if model.bounds else float("nan"), math.lgamma(model.k + 1)
    return spark.createDataFrame(
        [(model.k, bound, lfact, bound + lfact, len(model.bounds))],
        "K int, bound double, lfact double, lbound double, iterations int",
    )


def coherence_and_exclusivity(beta: DataFrame, counts: DataFrame, m: int = 10) -> DataFrame:
    """``(K, topic, semantic_coherence, exclusivity)`` from ``(K, topic, term, beta)``: all K in one scan of the counts.

    Topics of different K are told apart by a number of both; for exclusivity terms are compared within the
    same K. Both figures are of the same leading terms, which are found once.
    """
    apart = F.col("K").cast("long") * (1 << 20) + F.col("topic")
    rated = _rated(beta.select("K", apart.alias("topic"), "term", "beta"), ["K"]).drop("K")
    leading = written(_leading(rated, m), "leading")
    joined = _coherence(leading.select("topic", "term", "rank"), counts, m).join(_exclusive(rated, leading, m), "topic")
    return joined.select(
        F.shiftright("topic", 20).cast("int").alias("K"), F.col("topic").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("topic"),
        "semantic_coherence", "exclusivity")


def k_diagnostics(
    models: Mapping[int, TopicModel], vocab: DataFrame, counts: DataFrame, heldout: DataFrame, m: int = 10,
) -> DataFrame:
    """``(K, metric, value)``: five figures for each number of topics.

    Topics and proportions of all K are written once, each in one scan, and cells meet those of all K at once.
    """
    metrics = ["exclusivity", "lower_bound", "residuals", "semantic_coherence", "heldout_likelihood"]
    spark = counts.sparkSession
    betas, mixtures = written(every_topic_terms(models, vocab), "beta"), written(every_topic_mixtures(models), "gamma")
    swept(spark)  # what the fit has shuffled and written on its way
    per_topic = coherence_and_exclusivity(betas, counts, m)
    means = written(per_topic.groupBy("K").agg(F.avg("exclusivity").alias("exclusivity"), F.avg("semantic_coherence").alias("semantic_coherence")))
    bounds = reduce(DataFrame.unionByName, [model_bound(model, spark).select("K", F.col("lbound").alias("lower_bound")) for model in models.values()])
    residuals = residual_dispersion(counts, mixtures, betas).withColumnRenamed("residual_dispersion", "residuals")
    likelihoods = heldout_likelihood(heldout, mixtures, betas).select("K", "heldout_likelihood")
    wide = reduce(lambda rows, more: rows.join(more, "K", "left"), [residuals, likelihoods, means], bounds)
    return pivot_longer(wide.select("K", *metrics), ["K"], metrics)


def coherence_vs_exclusivity(per_k: Mapping[int, DataFrame], counts: DataFrame, m: int = 10) -> DataFrame:
    """``(K, topic, semantic_coherence, exclusivity)`` for a beta table per K."""
    tables = [beta.select(F.lit(k).alias("K"), "topic", "term", "beta") for k, beta in per_k.items()]
    return coherence_and_exclusivity(reduce(DataFrame.unionByName, tables), counts, m)
