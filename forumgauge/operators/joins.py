"""Joins of the logical tables. All are equi-joins; which side is broadcast is left
to Spark's size check, and hot keys to the adaptive skew join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import single
from ..functions.wordlists import COARSE_LABELS

SAMPLE_ID = "12345"


def left_enrich(df: DataFrame, details: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Add the columns of ``details``; rows without a match stay."""
    key = details[right_key].alias("__key")
    others = [c for c in details.columns if c != right_key]
    details = details.select(key, *others)
    return df.join(details, F.col(left_key) == F.col("__key"), "left").drop("__key")


def score_join(episodes: DataFrame, scores: DataFrame, comments: DataFrame, sample_id: str = SAMPLE_ID) -> DataFrame:
    """Episodes with their scored comments: ``scores`` matched on video, ``comments`` on
    comment id and video, without the sample row.

    Excluding the sample row also excludes episodes without any score, so this is
    written as the inner join it amounts to, the selective comment join first.
    """
    real = scores.where(F.col("id").cast("string") != sample_id)
    return real.join(comments, ["id", "video_id"], "left").join(episodes, "video_id")


def comments_with_scores(comments: DataFrame, scores: DataFrame) -> DataFrame:
    """All comments, scored or not."""
    return comments.join(scores.drop("video_id"), "id", "left")


def semi_filter(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    table = keys.select(F.col(key or on).alias("__key"))
    return df.join(table, F.col(on) == F.col("__key"), "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in ``keys``; a null key stays."""
    table = keys.select(F.col(key or on).alias("__key"))
    return df.join(table, F.col(on) == F.col("__key"), "left_anti")


def gold_pred_join(gold: DataFrame, predicted: DataFrame, key: str = "tweet_no") -> DataFrame:
    """``(key, truth, predicted)``: every gold row with its prediction, if any."""
    return gold.select(key, "truth").join(predicted.select(key, "predicted"), key, "left")


def annotation_join(annotated: DataFrame, scored: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``(text, truth, predicted, score)`` of annotations matched by text.

    Only distinct rows are wanted, so both sides are made distinct before the join:
    a text with many copies never multiplies with itself.
    """
    truth = annotated.select(text, "truth").distinct()
    predictions = scored.select(text, F.col("label").alias("predicted"), "score").distinct()
    return truth.join(predictions, text, "left")


def complete_grid(
    df: DataFrame, entity: str, label: str = "label", labels: Sequence[str] = COARSE_LABELS, rest: str | None = None
) -> DataFrame:
    """``(entity, label, n)`` for every entity and every label, zero where absent.

    ``labels`` come first; labels of the data that are not among them follow, unless
    ``rest`` names a label under which all of those are counted. Null is an entity, and
    null labels are not counted. Labels are few, so the counts per entity are gathered
    in a map of one entry per label and unfolded; no grid has to be built and joined.
    """
    known = F.col(label).isNotNull()
    if rest is not None:
        listed = F.col(label).isin(list(labels))
        df = df.withColumn(label, F.when(listed | ~known, F.col(label)).otherwise(rest))
        labels = (*labels, rest)
    counts = df.groupBy(entity, F.col(label).alias("__label")).agg(F.count_if(known).alias("__n"))
    cell = F.when(F.col("__label").isNotNull(), F.struct("__label", "__n"))
    per_entity = counts.groupBy(entity).agg(F.map_from_entries(F.collect_list(cell)).alias("__map"))
    found = single(counts.agg(F.array_sort(F.collect_set("__label")).alias("a")))
    every = F.array_union(F.array(*[F.lit(v) for v in labels]), F.coalesce(found, F.array().cast("array<string>")))
    spread = per_entity.select(entity, "__map", F.explode(every).alias("label"))
    return spread.select(entity, "label", F.coalesce(F.try_element_at("__map", F.col("label")), F.lit(0)).alias("n"))


def topic_share_join(gamma: DataFrame, shares: DataFrame, document: str = "document", video: str = "video_id"):
    """Topic proportions of documents with the toxic share of the same episode."""
    return left_enrich(gamma, shares, document, video)


def topic_date_join(topic_rows: DataFrame, episodes: DataFrame, shares: DataFrame, on: str = "date") -> DataFrame:
    """Topic rows with episodes and their toxic share.

    ``on="date"`` matches all episodes of the day, ``on="video_id"`` only the episode
    the topic row belongs to.
    """
    share = shares.select("video_id", "date", "prop_offense")
    if on == "video_id":
        episodes = episodes.drop("date")
    return topic_rows.join(episodes, on, "left").join(share, ["video_id", "date"], "left")
