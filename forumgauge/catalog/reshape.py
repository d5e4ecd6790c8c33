"""Queries for set operations and reshaping."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import reshape as op
from ..operators.aggregates import count_by
from ..operators.evaluation import CELLS, confusion_wide
from ..operators.text import tokenize_words
from ..operators.topics import top_terms
from . import query
from .tables import LANGUAGES, WORD_SQL


@query("union_by_name", """
SELECT id, video_id, NULL AS label FROM comments UNION ALL SELECT id, video_id, label FROM scores""", "comments scores")
def _(t):
    return op.union_by_name(t.comments.select("id", "video_id"), t.scores.select("id", "video_id", "label"))


@query("union_tagged", f"""
WITH words AS (
  SELECT id AS document, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word, 'comments' AS origin FROM scored WHERE label = 'OFFENSE'
  UNION ALL SELECT vid, word, 'subtitles' FROM subtitle_words)
SELECT origin, document, word, lang, count(*) AS n FROM words LEFT JOIN documents ON document = doc_id GROUP BY ALL""", "scored subtitle_words")
def _(t):
    toxic = t.scored.where("label = 'OFFENSE'").select(F.col("id").alias("document"), "text")
    counts = {
        "comments": count_by(tokenize_words(toxic), "document", "word"),
        "subtitles": count_by(t.subtitle_words.withColumnRenamed("vid", "document"), "document", "word"),
    }
    details = t.raw("documents").select(F.col("doc_id").alias("document"), "lang")
    return op.union_tagged(counts).join(details, "document", "left").select("origin", "document", "word", "lang", "n")


@query("distinct_rows", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def _(t):
    documents = t.raw("documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "doc_id")
    return op.distinct_rows(documents, ["text_md5", "lang"])


@query("shared_terms", """
WITH ranked AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta)
SELECT term, count(*) AS n FROM ranked WHERE r <= 10 GROUP BY term""", "beta")
def _(t):
    return op.shared_terms(top_terms(t.beta, 10))


@query("pivot_wider", """
SELECT document, round(max(gamma) FILTER (topic = 1), 6) AS t_1, round(max(gamma) FILTER (topic = 2), 6) AS t_2,
       round(max(gamma) FILTER (topic = 3), 6) AS t_3, round(max(gamma) FILTER (topic = 4), 6) AS t_4 FROM gamma GROUP BY document""", "gamma")
def _(t):
    topics = range(1, len(LANGUAGES) + 1)
    wide = op.pivot_wider(t.gamma, ["document"], "topic", "gamma", topics, "t_")
    return rounded(wide, *[f"t_{i}" for i in topics])


@query("pivot_longer", """
SELECT lang, metric, value FROM (
  SELECT lang, count(*) FILTER (truth = 'OFFENSE' AND predicted = 'OFFENSE') AS true_positives, count(*) FILTER (truth = 'OFFENSE' AND predicted <> 'OFFENSE') AS false_negatives
  FROM annotated JOIN documents ON id = doc_id GROUP BY lang) UNPIVOT (value FOR metric IN (true_positives, false_negatives))""", "annotated")
def _(t):
    languages = t.raw("documents").select(F.col("doc_id").alias("id"), "lang")
    hit, truth = F.col("predicted") == "OFFENSE", F.col("truth") == "OFFENSE"
    wide = t.annotated.join(languages, "id").groupBy("lang").agg(
        F.count_if(truth & hit).alias("true_positives"), F.count_if(truth & ~hit).alias("false_negatives")
    )
    return op.pivot_longer(wide, ["lang"], ["true_positives", "false_negatives"])


@query("confusion_long", """
SELECT metric, value FROM (SELECT
  count(*) FILTER (truth = 'OFFENSE' AND predicted = 'OFFENSE') AS true_positives, count(*) FILTER (truth = 'OFFENSE' AND predicted <> 'OFFENSE') AS false_negatives,
  count(*) FILTER (truth <> 'OFFENSE' AND predicted = 'OFFENSE') AS false_positives, count(*) FILTER (truth <> 'OFFENSE' AND predicted <> 'OFFENSE') AS true_negatives
  FROM annotated) UNPIVOT (value FOR metric IN (true_positives, false_negatives, false_positives, true_negatives))""", "annotated")
def _(t):
    return op.pivot_longer(confusion_wide(t.annotated), [], CELLS)


@query("unnest_lists", """
SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS line_md5 FROM documents""")
def _(t):
    lines = t.raw("documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return op.unnest_lists(lines, "lines", "line").select("doc_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("separate_column", """
SELECT term, n, 't' AS junk, TRY_CAST(split_part(term, '_', 2) AS INT) AS topic
FROM (SELECT 't_' || lang || '' AS term, count(*) AS n FROM documents GROUP BY lang
      UNION ALL SELECT 't_' || CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY toxic)""")
def _(t):
    names = lambda c: F.concat(F.lit("t_"), F.col(c).cast("string")).alias("term")
    terms = t.raw("documents").select(names("lang")).unionByName(t.raw("labels").select(names("toxic")))
    return op.separate_column(count_by(terms, "term"), "term", ["junk", "topic"], integers=["topic"])
