"""Scoring of portions and combining portion scores into comment scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.wordlists import OFFENSE, OTHER


class Scorer(Protocol):
    """Adds ``label``, ``score`` (confidence in that label) and ``error`` to portions."""

    def score(self, portions: DataFrame, text: str) -> DataFrame: ...


class LexiconScorer:
    """Scores by the number of listed words, as one column expression.

    With ``h`` hits the odds of OFFENSE are ``h`` to ``weight``.
    """

    def __init__(self, terms: Sequence[str], weight: float = 1.0):
        self.terms = list(terms)
        self.weight = weight

    def score(self, portions: DataFrame, text: str) -> DataFrame:
        hits = F.size(F.filter(tx.words(F.col(text)), lambda w: w.isin(self.terms)))
        p = F.col("__hits") / (F.col("__hits") + F.lit(self.weight))
        return (
            portions.withColumn("__hits", hits)
            .withColumns({
                "label": F.when(p > 0.5, OFFENSE).otherwise(OTHER),
                "score": F.greatest(p, 1 - p),
                "error": F.lit(None).cast("string"),
            })
            .drop("__hits")
        )


class PipelineScorer:
    """Hashed bag of words and logistic regression, trained on a labelled table.

    Words are hashed to ``features`` columns, so none is left out and no vocabulary is held on the driver.
    """

    def __init__(self, model: PipelineModel):
        self.model = model

    @classmethod
    def train(
        cls, labelled: DataFrame, text: str = "text", label: str = "label",
        features: int = 1 << 18, iterations: int = 20, penalty: float = 0.01,
    ) -> PipelineScorer:
        rows = labelled.select(
            tx.words(F.col(text)).alias("__words"), (F.col(label) == OFFENSE).cast("double").alias("__y")
        )
        stages = [
            HashingTF(inputCol="__words", outputCol="__counts", numFeatures=features),
            LogisticRegression(
                featuresCol="__counts", labelCol="__y", maxIter=iterations, regParam=penalty,
                rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction",
            ),
        ]
        return cls(Pipeline(stages=stages).fit(rows))

    def score(self, portions: DataFrame, text: str) -> DataFrame:
        scored = self.model.transform(portions.withColumn("__words", tx.words(F.col(text))))
        p = F.get(vector_to_array("__probability"), 1)
        return scored.withColumns({
            "label": F.when(p > 0.5, OFFENSE).otherwise(OTHER),
            "score": F.greatest(p, 1 - p),
            "error": F.lit(None).cast("string"),
        }).drop("__words", "__counts", "__raw", "__probability", "__prediction")


class PandasScorer:
    """A user model that works on batches of texts.

    ``load`` runs once per partition and ``predict(model, texts)`` returns one
    ``(label, score)`` per text. A batch that fails is retried text by text, and a text
    that fails keeps its error message instead of a score.
    """

    def __init__(self, load: Callable[[], Any], predict: Callable[[Any, pd.Series], list[tuple[str, float]]]):
        self.load = load
        self.predict = predict

    def score(self, portions: DataFrame, text: str) -> DataFrame:
        load, predict = self.load, self.predict

        def one(model, value):
            try:
                label, score = predict(model, pd.Series([value]))[0]
                return label, score, None
            except Exception as failure:  # the message is the result for this row
                return None, None, f"{type(failure).__name__}: {failure}"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                try:
                    rows = [(label, score, None) for label, score in predict(model, batch[text])]
                except Exception:
                    rows = [one(model, value) for value in batch[text]]
                scored = pd.DataFrame(rows, columns=["label", "score", "error"], index=batch.index)
                yield batch.join(scored)

        schema = T.StructType([
            *portions.schema.fields,
            T.StructField("label", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ])
        return portions.mapInPandas(run, schema)


def score_portions(portions: DataFrame, scorer: Scorer, text: str = "comments_reportion") -> DataFrame:
    """Label, score and error for every portion."""
    return scorer.score(portions, text)


def combine_portions(portion_scores: DataFrame, keys: Sequence[str] = ("id", "video_id"), mode: str = "corrected"):
    """One label and score per comment.

    A comment in several portions with both labels gets the mean probability: of
    OFFENSE by default, and OFFENSE if above one half. ``mode="reference"`` averages the
    probability of OTHER but compares it the same way, which turns the label around.
    Any other comment keeps its label with the mean score. One aggregate does all. The
    mean is compared at nine digits, so the order of summation can not decide a label.
    """
    if mode not in ("corrected", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    toxic = F.col("label") == OFFENSE
    toward = F.when(toxic if mode == "corrected" else ~toxic, F.col("score")).otherwise(1 - F.col("score"))
    grouped = portion_scores.groupBy(*keys).agg(
        F.avg(F.when(toxic, F.col("score"))).alias("offense"),
        F.avg(F.when(~toxic, F.col("score"))).alias("other"),
        F.count_if(toxic).alias("n_offense"),
        F.count_if(~toxic).alias("n_other"),
        F.max("group_no").alias("portions"),
        F.avg(toward).alias("mean"),
    )
    cell = lambda label, score: F.struct(label.alias("label"), score.alias("score"))
    mixed = cell(F.when(F.round("mean", 9) > 0.5, OFFENSE).otherwise(OTHER), F.col("mean"))
    plain = F.filter(
        F.array(
            F.when(F.col("n_offense") > 0, cell(F.lit(OFFENSE), F.col("offense"))),
            F.when(F.col("n_other") > 0, cell(F.lit(OTHER), F.col("other"))),
        ),
        lambda c: c.isNotNull(),
    )
    is_mixed = (F.col("portions") > 1) & (F.col("n_offense") > 0) & (F.col("n_other") > 0)
    return grouped.select(*keys, F.inline(F.when(is_mixed, F.array(mixed)).otherwise(plain)))


def combine_portions_eval(portion_scores: DataFrame, mode: str = "corrected") -> DataFrame:
    """The variant used for the gold set: one row per portion.

    Whether a text is mixed is still decided over all its portions, but every portion
    is averaged by itself; a mixed text's portions are expressed as one probability.
    """
    toxic = F.col("label") == OFFENSE
    per_portion = portion_scores.groupBy("id", "group_no").agg(
        F.avg(F.when(toxic, F.col("score"))).alias("offense"),
        F.avg(F.when(~toxic, F.col("score"))).alias("other"),
        F.count_if(toxic).alias("n_offense"),
        F.count_if(~toxic).alias("n_other"),
        F.avg(F.when(toxic if mode == "corrected" else ~toxic, F.col("score")).otherwise(1 - F.col("score"))).alias("mean"),
    )
    mixed = portion_scores.groupBy("id").agg(
        ((F.max("group_no") > 1) & (F.count_if(toxic) > 0) & (F.count_if(~toxic) > 0)).alias("is_mixed")
    )
    cell = lambda label, score: F.struct(label.alias("label"), score.alias("score"))
    one = cell(F.when(F.round("mean", 9) > 0.5, OFFENSE).otherwise(OTHER), F.col("mean"))
    plain = F.filter(
        F.array(
            F.when(F.col("n_offense") > 0, cell(F.lit(OFFENSE), F.col("offense"))),
            F.when(F.col("n_other") > 0, cell(F.lit(OTHER), F.col("other"))),
        ),
        lambda c: c.isNotNull(),
    )
    cells = F.when(F.col("is_mixed"), F.array(one)).otherwise(plain)
    return per_portion.join(mixed, "id").select("id", "group_no", F.inline(cells))


def label_violations(combined: DataFrame, key: str = "id", rule: str = "one_label") -> DataFrame:
    """Comments that break the rule of one label each.

    ``rule="one_label"`` finds ids with different labels, ``"no_repeat"`` ids that carry
    the same label twice.
    """
    if rule == "one_label":
        return combined.groupBy(key).agg(F.count_distinct("label").alias("n")).where(F.col("n") > 1)
    if rule == "no_repeat":
        return combined.groupBy(key, "label").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    raise ValueError(f"unknown rule {rule!r}")


def assert_one_label(combined: DataFrame, key: str = "id", rule: str = "one_label") -> DataFrame:
    """Return ``combined`` unchanged, or raise naming one offending comment."""
    bad = label_violations(combined, key, rule).take(1)
    if bad:
        raise ValueError(f"more than one label, e.g. {bad[0].asDict()}")
    return combined
