"""From raw comments to the toxicity of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import single
from ..operators.aggregates import toxic_share
from ..operators.evaluation import correction_factor
from ..operators.joins import score_join
from ..operators.scoring import Scorer, combine_portions, score_portions
from ..operators.text import clean_text, portion_text
from ..operators.windows import rolling_mean
from ..sources.sinks import split_results_errors


def score_comments(comments: DataFrame, scorer: Scorer, path: str, size: int = 300) -> DataFrame:
    """Clean, cut, score and combine. Portion scores are written once below ``path``,
    results apart from errors, so the expensive step is never repeated."""
    cleaned = clean_text(comments.select("id", "video_id", "text"), output="text")
    scored = score_portions(portion_text(cleaned, size=size), scorer)
    results, _ = split_results_errors(scored, path)
    return combine_portions(results)


def toxicity_report(
    episodes: DataFrame, scores: DataFrame, comments: DataFrame, annotated: DataFrame, rows: int = 15
) -> DataFrame:
    """Per episode: corrected number of toxic comments, their share, the moving mean."""
    factor = single(correction_factor(annotated))
    scored = score_join(episodes.select("video_id", "date"), scores, comments.select("id", "video_id"))
    shares = rolling_mean(toxic_share(scored, factor), rows=rows)
    details = episodes.select("video_id", "title", "view_count")
    return shares.join(details, "video_id", "left").select(
        "video_id", "title", "date", "view_count",
        *[F.round(c, 6).alias(c) for c in ("n", "prop_offense", "rolling_mean")],
    )
