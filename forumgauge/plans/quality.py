"""How good a classifier is, on a gold set and on hand-made labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import confusion_metrics, correction_factor, multiclass_report, resampled_correction
from ..operators.joins import annotation_join, gold_pred_join
from ..operators.scoring import Scorer, combine_portions, score_portions
from ..operators.text import clean_text, portion_text
from ..functions.wordlists import COARSE_LABELS
from ..sources.sinks import split_results_errors


def predict_gold(gold: DataFrame, scorer: Scorer, path: str, size: int = 300) -> DataFrame:
    """``(tweet_no, truth, predicted)`` for a gold set ``(tweet, coarse, ..., tweet_no)``."""
    cleaned = clean_text(gold.select(F.col("tweet_no").alias("id"), "tweet"), "tweet", "text", profile="tweet")
    scored = score_portions(portion_text(cleaned.select("id", "text"), size=size), scorer)
    results, _ = split_results_errors(scored, path)
    predicted = combine_portions(results, keys=["id"])
    return gold_pred_join(
        gold.select("tweet_no", F.col("coarse").alias("truth")),
        predicted.select(F.col("id").alias("tweet_no"), F.col("label").alias("predicted")),
    )


def gold_reports(pairs: DataFrame) -> dict[str, DataFrame]:
    """The figures per class and the shared-task report."""
    return {"metrics": confusion_metrics(pairs), "report": multiclass_report(pairs, COARSE_LABELS)}


def annotation_reports(annotated: DataFrame, scored: DataFrame, replicates: int = 2500) -> dict[str, DataFrame]:
    """Quality on hand-made labels matched by text, and the correction derived from it."""
    pairs = annotation_join(annotated, scored)
    return {
        "metrics": confusion_metrics(pairs),
        "correction": correction_factor(pairs),
        "resampled": resampled_correction(pairs, replicates),
    }
