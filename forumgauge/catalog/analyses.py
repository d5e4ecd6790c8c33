"""Queries for whole analyses: comments to scores, and the quality of a classifier."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import evaluation
from ..operators.scoring import LexiconScorer
from ..plans.comments import score_comments
from ..plans.quality import annotation_reports, gold_reports, predict_gold
from ..session import scratch_path
from . import query
from .evaluation import CELLS_SQL, METRICS_SQL
from .scoring import LEXICON, LEXICON_SQL
from .tables import WORD_SQL
from .text import STEPS, TWEET_STEPS, _clean_sql

WEIGHT = 20


def _scored_sql(steps) -> str:
    """Documents cleaned, cut, scored by the lexicon and combined: table ``combined`` (id, label, score)."""
    toward = "avg(CASE WHEN label = 'OFFENSE' THEN score ELSE 1 - score END)"
    return f"""cleaned AS (SELECT doc_id AS id, {_clean_sql("text", steps)} AS text FROM documents),
toks AS (SELECT id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS i
         FROM (SELECT id, string_split(regexp_replace(text, ' \\z', ''), ' ') AS tk FROM cleaned WHERE text <> '')),
cut AS (SELECT id, (i - 1) // 300 AS no, string_agg(tok, ' ' ORDER BY i) AS portion FROM toks GROUP BY id, (i - 1) // 300),
h AS (SELECT id, no, len(list_filter(regexp_extract_all(lower(portion), '{WORD_SQL}'), lambda w: w IN ({LEXICON_SQL})))::DOUBLE AS h FROM cut),
scored_cuts AS (SELECT id, no, CASE WHEN h / (h + {WEIGHT}) > 0.5 THEN 'OFFENSE' ELSE 'OTHER' END AS label, greatest(h / (h + {WEIGHT}), 1 - h / (h + {WEIGHT})) AS score FROM h),
mixed AS (SELECT id FROM scored_cuts GROUP BY id HAVING max(no) > 0 AND count(DISTINCT label) > 1),
combined AS (
  SELECT id, CASE WHEN round({toward}, 9) > 0.5 THEN 'OFFENSE' ELSE 'OTHER' END AS label, {toward} AS score FROM scored_cuts WHERE id IN (SELECT id FROM mixed) GROUP BY id
  UNION ALL SELECT id, label, avg(score) FROM scored_cuts WHERE id NOT IN (SELECT id FROM mixed) GROUP BY id, label)"""


def _lexicon():
    return LexiconScorer(LEXICON, weight=float(WEIGHT))


@query("score_comments", f"""WITH {_scored_sql(STEPS)}
SELECT id, source AS video_id, label, round(score, 6) AS score FROM combined JOIN documents ON id = doc_id""")
def _(t):
    return rounded(score_comments(t.comments, _lexicon(), scratch_path(t.spark, "scores")).select("id", "video_id", "label", "score"), "score")


PAIRS_SQL = f"""{_scored_sql(TWEET_STEPS)},
pairs AS (SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'OFFENSE' ELSE 'OTHER' END AS truth, c.label AS predicted
          FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN combined c ON c.id = l.doc_id)"""


def _gold_pairs(t):
    gold = t.raw("labels").select("doc_id", F.when(F.col("toxic") == 1, "OFFENSE").otherwise("OTHER").alias("coarse"))
    gold = t.raw("documents").select("doc_id", F.col("text").alias("tweet")).join(gold, "doc_id")
    return predict_gold(gold.withColumnRenamed("doc_id", "tweet_no"), _lexicon(), scratch_path(t.spark, "gold"))


@query("gold_predictions", f"WITH {PAIRS_SQL} SELECT doc_id AS tweet_no, truth, predicted FROM pairs")
def _(t):
    return _gold_pairs(t)


@query("gold_metrics", f"WITH {PAIRS_SQL}, c AS (SELECT {CELLS_SQL} FROM pairs) SELECT {METRICS_SQL} FROM c")
def _(t):
    return rounded(gold_reports(_gold_pairs(t))["metrics"], *evaluation.METRICS)


@query("annotation_metrics", f"""
WITH a AS (SELECT DISTINCT d.text, an.truth FROM annotated an JOIN documents d ON an.id = d.doc_id),
s AS (SELECT DISTINCT text, label AS predicted, score FROM scored),
j AS (SELECT a.text, truth, predicted, score FROM a LEFT JOIN s ON a.text = s.text), c AS (SELECT {CELLS_SQL} FROM j)
SELECT {METRICS_SQL} FROM c""", "annotated scored")
def _(t):
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(annotation_reports(t.annotated.join(texts, "id"), t.scored)["metrics"], *evaluation.METRICS)
