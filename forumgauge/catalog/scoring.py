"""Queries for scoring and combining portions."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import scoring as op
from . import query
from .tables import WORD_SQL

# Frequent words of the corpus, in place of a list of insults.
LEXICON = ("der", "die", "the", "of", "de", "la")
LEXICON_SQL = ", ".join(f"'{w}'" for w in LEXICON)

MULTI_SQL = """multi AS (SELECT id FROM portion_scores GROUP BY id HAVING max(group_no) > 1 AND count(DISTINCT label) > 1)"""


@query("score_portions", f"""
WITH h AS (SELECT id, group_no, len(list_filter(regexp_extract_all(lower(comments_reportion), '{WORD_SQL}'), lambda w: w IN ({LEXICON_SQL})))::DOUBLE AS h FROM portions)
SELECT id, group_no, CASE WHEN h / (h + 20) > 0.5 THEN 'OFFENSE' ELSE 'OTHER' END AS label, round(greatest(h / (h + 20), 1 - h / (h + 20)), 6) AS score FROM h""",
       "portions")
def _(t):
    scored = op.score_portions(t.portions, op.LexiconScorer(LEXICON, weight=20.0))
    return rounded(scored.select("id", "group_no", "label", "score"), "score")


@query("score_portions_model", "SELECT id, group_no, true AS label_known, true AS score_in_range FROM portions", "portions")
def _(t):
    documents = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    labelled = t.scores.select("id", "label").join(documents, "id")
    scored = op.score_portions(t.portions, op.PipelineScorer.train(labelled))
    return scored.select(
        "id", "group_no", F.col("label").isin("OFFENSE", "OTHER").alias("label_known"), F.col("score").between(0.5, 1.0).alias("score_in_range")
    )


@query("score_portions_pandas", """
SELECT id, group_no, CASE WHEN comments_reportion LIKE '%###%' THEN NULL WHEN length(comments_reportion) % 3 = 0 THEN 'OFFENSE' ELSE 'OTHER' END AS label,
       CASE WHEN comments_reportion LIKE '%###%' THEN NULL ELSE 0.75::DOUBLE END AS score,
       CASE WHEN comments_reportion LIKE '%###%' THEN 'ValueError: unreadable' END AS error FROM portions""", "portions")
def _(t):
    def predict(model, texts):
        if texts.str.contains("###", regex=False).any():
            raise ValueError("unreadable")
        return [("OFFENSE" if len(text) % 3 == 0 else "OTHER", 0.75) for text in texts]

    scorer = op.PandasScorer(load=lambda: None, predict=predict)
    return op.score_portions(t.portions, scorer).select("id", "group_no", "label", "score", "error")


def _combined(mode: str, toward: str) -> str:
    p = f"avg(CASE WHEN label = '{toward}' THEN score ELSE 1 - score END)"
    return f"""SELECT '{mode}' AS mode, id, video_id, CASE WHEN round({p}, 9) > 0.5 THEN 'OFFENSE' ELSE 'OTHER' END AS label, round({p}, 6) AS score
FROM portion_scores WHERE id IN (SELECT id FROM multi) GROUP BY id, video_id
UNION ALL SELECT '{mode}', id, video_id, label, round(avg(score), 6) FROM portion_scores WHERE id NOT IN (SELECT id FROM multi) GROUP BY id, video_id, label"""


@query("combine_portions", f"WITH {MULTI_SQL} {_combined('corrected', 'OFFENSE')} UNION ALL {_combined('reference', 'OTHER')}", "portion_scores")
def _(t):
    modes = ("corrected", "reference")
    both = [op.combine_portions(t.portion_scores, mode=m).withColumn("mode", F.lit(m)) for m in modes]
    return rounded(both[0].unionByName(both[1]), "score")


@query("combine_portions_eval", f"""WITH {MULTI_SQL}
SELECT id, group_no, CASE WHEN round(avg(CASE WHEN label = 'OFFENSE' THEN score ELSE 1 - score END), 9) > 0.5 THEN 'OFFENSE' ELSE 'OTHER' END AS label,
       round(avg(CASE WHEN label = 'OFFENSE' THEN score ELSE 1 - score END), 6) AS score FROM portion_scores WHERE id IN (SELECT id FROM multi) GROUP BY id, group_no
UNION ALL SELECT id, group_no, label, round(avg(score), 6) FROM portion_scores WHERE id NOT IN (SELECT id FROM multi) GROUP BY id, group_no, label""",
       "portion_scores")
def _(t):
    return rounded(op.combine_portions_eval(t.portion_scores), "score")


@query("assert_one_label", """
SELECT 'one_label' AS rule, CAST(0 AS BIGINT) AS violations, (SELECT count(DISTINCT id) FROM portion_scores) AS n
UNION ALL SELECT 'portions', (SELECT count(*) FROM (SELECT id FROM portion_scores GROUP BY id HAVING count(DISTINCT label) > 1)), (SELECT count(DISTINCT id) FROM portion_scores)""",
       "portion_scores")
def _(t):
    combined = op.assert_one_label(op.combine_portions(t.portion_scores))
    row = lambda df, rule: op.label_violations(df).agg(F.count("*").alias("violations")).select(
        F.lit(rule).alias("rule"), "violations", df.agg(F.count_distinct("id").alias("n")).scalar().alias("n")
    )
    return row(combined, "one_label").unionByName(row(t.portion_scores, "portions"))
