"""Queries for classifier quality."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..functions.wordlists import COARSE_LABELS, FINE_LABELS
from ..operators import evaluation as op
from ..operators.aggregates import count_by
from . import query

CELLS_SQL = """
  count(*) FILTER (truth = 'OFFENSE' AND predicted = 'OFFENSE') AS tp, count(*) FILTER (truth = 'OFFENSE' AND predicted <> 'OFFENSE') AS fn,
  count(*) FILTER (truth <> 'OFFENSE' AND predicted = 'OFFENSE') AS fp, count(*) FILTER (truth <> 'OFFENSE' AND predicted <> 'OFFENSE') AS tn"""


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0))"


SENS, SPEC, PPV = _div("tp", "tp + fn"), _div("tn", "tn + fp"), _div("tp", "tp + fp")
METRICS_SQL = ", ".join(f"round({e}, 6) AS {n}" for n, e in {
    "sensitivity": SENS, "specificity": SPEC, "pos_pred_value": PPV, "neg_pred_value": _div("tn", "tn + fn"),
    "precision": PPV, "recall": SENS, "f1": _div("2 * tp", "2 * tp + fp + fn"), "prevalence": _div("tp + fn", "tp + fn + fp + tn"),
    "detection_rate": _div("tp", "tp + fn + fp + tn"), "detection_prevalence": _div("tp + fp", "tp + fn + fp + tn"),
    "balanced_accuracy": f"({SENS} + {SPEC}) / 2",
}.items())


@query("confusion_counts", f"""
WITH c AS (SELECT {CELLS_SQL} FROM annotated)
SELECT metric, n, round(n * 100.0::DOUBLE / (SELECT tp + fn + fp + tn FROM c), 6) AS percent FROM (
  SELECT 'true_positives' AS metric, tp AS n FROM c UNION ALL SELECT 'false_negatives', fn FROM c
  UNION ALL SELECT 'false_positives', fp FROM c UNION ALL SELECT 'true_negatives', tn FROM c)""", "annotated")
def _(t):
    return rounded(op.confusion_counts(t.annotated), "percent")


@query("confusion_metrics", f"WITH c AS (SELECT {CELLS_SQL} FROM annotated) SELECT {METRICS_SQL} FROM c", "annotated")
def _(t):
    return rounded(op.confusion_metrics(t.annotated), *op.METRICS)


def _sweep(direction: str) -> str:
    return f"""SELECT '{direction}' AS direction, round(threshold, 6) AS threshold, {METRICS_SQL} FROM (
  SELECT threshold, {CELLS_SQL} FROM (
    SELECT threshold, truth, CASE WHEN score {direction} threshold AND predicted = 'OFFENSE' THEN 'OFFENSE' ELSE 'OTHER' END AS predicted
    FROM annotated, (SELECT 0.5::DOUBLE + (0.9::DOUBLE - 0.5::DOUBLE) * i / 9 AS threshold FROM range(10) r(i))) GROUP BY threshold)"""


@query("threshold_sweep", f"{_sweep('<=')} UNION ALL {_sweep('>=')}", "annotated")
def _(t):
    both = [op.threshold_sweep(t.annotated, direction=d).withColumn("direction", F.lit(d)) for d in ("<=", ">=")]
    return rounded(both[0].unionByName(both[1]), "threshold", *op.METRICS)


@query("score_histogram_by_truth", """
WITH r AS (SELECT min(score) AS lo, (max(score) - min(score)) / 30 AS w FROM annotated)
SELECT predicted, truth, CAST(least(floor((score - lo) / w), 29) AS BIGINT) AS bin, round(lo + least(floor((score - lo) / w), 29) * w, 6) AS bin_start, count(*) AS n
FROM annotated, r GROUP BY ALL""", "annotated")
def _(t):
    return rounded(op.score_histogram_by_truth(t.annotated), "bin_start")


@query("label_distribution", """
SELECT 'truth' AS kind, truth AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM annotated GROUP BY truth
UNION ALL SELECT 'predicted', predicted, count(*), round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) FROM annotated GROUP BY predicted""", "annotated")
def _(t):
    parts = [
        op.label_distribution(t.annotated, c).select(F.lit(c).alias("kind"), F.col(c).alias("label"), "n", "share")
        for c in ("truth", "predicted")
    ]
    return rounded(parts[0].unionByName(parts[1]), "share")


@query("correction_factor", """
SELECT round((count(*) FILTER (truth = 'OFFENSE'))::DOUBLE / count(*) FILTER (predicted = 'OFFENSE'), 6) AS factor FROM annotated""", "annotated")
def _(t):
    return rounded(op.correction_factor(t.annotated), "factor")


WALK_SQL = f"""WITH RECURSIVE cells AS (SELECT {CELLS_SQL} FROM annotated),
walk AS (
  SELECT r AS replicate, 0 AS draw, tp AS p1, fn AS p2, fp AS p3, tn AS p4, 0 AS g1, 0 AS g2, 0 AS g3 FROM cells, range(1, 2501) t(r)
  UNION ALL
  SELECT replicate, draw + 1, p1 - (cell = 1)::INT, p2 - (cell = 2)::INT, p3 - (cell = 3)::INT, p4 - (cell = 4)::INT,
         g1 + (cell = 1)::INT, g2 + (cell = 2)::INT, g3 + (cell = 3)::INT
  FROM (SELECT *, CASE WHEN mark < p1 THEN 1 WHEN mark < p1 + p2 THEN 2 WHEN mark < p1 + p2 + p3 THEN 3 ELSE 4 END AS cell
        FROM (SELECT *, floor(('0x' || substr(md5('42-' || replicate || '-' || (draw + 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (p1 + p2 + p3 + p4)) AS mark
              FROM walk WHERE draw < 40 AND p1 + p2 + p3 + p4 > 0))),
factors AS (SELECT replicate, (g1 + g2)::DOUBLE / nullif(g1 + g3, 0) AS factor FROM walk QUALIFY draw = max(draw) OVER ())"""


@query("resampled_correction", f"{WALK_SQL} SELECT CAST(replicate AS INT) AS replicate, round(factor, 6) AS factor FROM factors", "annotated")
def _(t):
    return rounded(op.resampled_correction(t.annotated), "factor")


@query("stratified_sample", """
SELECT id, label FROM scored QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) <= 125""", "scored")
def _(t):
    return op.stratified_sample(t.scored.select("id", "label"))


@query("apply_correction", f"""{WALK_SQL},
counts AS (SELECT video_id, label, count(*) AS n FROM scored GROUP BY video_id, label),
f AS (SELECT avg(factor) AS m, quantile_cont(factor, 0.025) AS lo, quantile_cont(factor, 0.975) AS hi FROM factors)
SELECT video_id, label, n, round(n * CASE WHEN label = 'OFFENSE' THEN m ELSE 1 END, 6) AS n_mean,
       round(n * CASE WHEN label = 'OFFENSE' THEN lo ELSE 1 END, 6) AS n_low, round(n * CASE WHEN label = 'OFFENSE' THEN hi ELSE 1 END, 6) AS n_high
FROM counts, f""", "annotated scored")
def _(t):
    counts = count_by(t.scored, "video_id", "label")
    return rounded(op.apply_correction(counts, op.resampled_correction(t.annotated)), "n_mean", "n_low", "n_high")


def _report_sql(table: str, labels) -> str:
    values = ", ".join(f"('{v}')" for v in labels)
    return f"""WITH c AS (
  SELECT label, count(*) FILTER (truth = label AND predicted = label)::DOUBLE AS tp, count(*) FILTER (truth <> label AND predicted = label) AS fp,
         count(*) FILTER (truth = label AND predicted <> label) AS fn
  FROM {table}, (VALUES {values}) v(label) GROUP BY label),
pr AS (SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c),
hit AS (SELECT count(*) FILTER (truth = predicted) AS correct, count(*) AS total FROM {table}),
rows AS (SELECT label AS category, p, r FROM pr UNION ALL SELECT 'AVERAGE', avg(p), avg(r) FROM pr)
SELECT category, floor(p * 100 * 100 + 0.5) / 100 AS precision, floor(r * 100 * 100 + 0.5) / 100 AS recall,
       floor(coalesce(2 * p * r / nullif(p + r, 0), 0) * 100 * 100 + 0.5) / 100 AS fscore,
       round(correct * 100.0::DOUBLE / total, 6) AS accuracy, correct, total
FROM rows, hit"""


@query("multiclass_report", _report_sql("fine_pairs", FINE_LABELS), "fine_pairs")
def _(t):
    return rounded(op.multiclass_report(t.fine_pairs, FINE_LABELS), "accuracy")


@query("multiclass_report_coarse", _report_sql("annotated", COARSE_LABELS), "annotated")
def _(t):
    return rounded(op.multiclass_report(t.annotated, COARSE_LABELS), "accuracy")


@query("validate_predictions", """
WITH pairs AS (SELECT f.*, d.lang, l.toxic, l.quality FROM fine_pairs f JOIN documents d ON f.id = d.doc_id JOIN labels l ON l.doc_id = f.id)
SELECT 'predictions' AS file, 'label_3' AS rule, lang AS detail, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'gold', 'columns', '4', count(*) FROM pairs WHERE quality = 0 HAVING count(*) > 0
UNION ALL SELECT 'both', 'row_count', (SELECT count(*) FROM documents) || ' / ' || (SELECT count(*) FROM labels), 1""", "fine_pairs")
def _(t):
    # files with flaws: a language in place of the fine label, and a fourth column
    tab = lambda *cs: F.concat_ws("\t", *cs).alias("line")
    labels = t.raw("labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    coarse = F.when(F.col("toxic") == 1, "OFFENSE").otherwise("OTHER")
    documents = t.raw("documents").select(F.col("doc_id").alias("id"), "lang")
    predictions = documents.join(labels, "id", "left").select(tab(F.col("id").cast("string"), coarse, "lang"))
    extra = F.when(F.col("quality") == 0, "extra")
    gold = t.fine_pairs.join(labels, "id").select(tab(F.col("id").cast("string"), coarse, "truth", extra))
    return op.validate_predictions(predictions, gold)
