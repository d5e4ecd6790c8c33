"""Queries for joins."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import joins as op
from ..operators import relate
from ..operators.topics import top_terms
from . import query


@query("left_enrich", """
SELECT s.vid, s.segment_id, d.source, d.lang FROM subtitles s LEFT JOIN documents d ON s.vid = d.doc_id""", "subtitles")
def _(t):
    details = t.raw("documents").select("doc_id", "source", "lang")
    return op.left_enrich(t.subtitles.select("vid", "segment_id"), details, "vid", "doc_id")


@query("score_join", """
SELECT id, video_id, label, round(score, 6) AS score, author_id, like_count, date FROM scored""", "scored")
def _(t):
    return rounded(t.scored.select("id", "video_id", "label", "score", "author_id", "like_count", "date"), "score")


@query("comments_with_scores", """
SELECT c.id, c.video_id, c.author_id, s.label, round(s.score, 6) AS score FROM comments c LEFT JOIN scores s ON c.id = s.id""",
       "comments scores")
def _(t):
    joined = op.comments_with_scores(t.comments, t.scores)
    return rounded(joined.select("id", "video_id", "author_id", "label", "score"), "score")


@query("semi_filter", "SELECT id, video_id FROM comments WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "comments")
def _(t):
    toxic = t.raw("labels").where("toxic = 1")
    return op.semi_filter(t.comments.select("id", "video_id"), toxic, "id", "doc_id")


@query("anti_filter", "SELECT id, video_id FROM comments c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.id)", "comments")
def _(t):
    return op.anti_filter(t.comments.select("id", "video_id"), t.raw("labels"), "id", "doc_id")


@query("gold_pred_join", """
SELECT d.doc_id AS tweet_no, d.lang AS truth, CASE WHEN l.toxic = 1 THEN 'OFFENSE' WHEN l.toxic = 0 THEN 'OTHER' END AS predicted
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    gold = t.raw("documents").select(F.col("doc_id").alias("tweet_no"), F.col("lang").alias("truth"))
    predicted = t.annotated.select(F.col("id").alias("tweet_no"), "predicted")
    return op.gold_pred_join(gold, predicted)


@query("annotation_join", """
SELECT DISTINCT md5(a.text) AS text_md5, a.truth, s.label AS predicted, round(s.score, 6) AS score
FROM (SELECT d.text, an.truth FROM annotated an JOIN documents d ON an.id = d.doc_id) a LEFT JOIN scored s ON a.text = s.text""",
       "annotated scored")
def _(t):
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    joined = op.annotation_join(t.annotated.join(texts, "id"), t.scored)
    return rounded(joined.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "truth", "predicted", "score"), "score")


@query("complete_grid", """
SELECT a.author_id, l.label, coalesce(n, 0) AS n
FROM (SELECT DISTINCT author_id FROM author_comments) a CROSS JOIN (VALUES ('OFFENSE'), ('OTHER')) l(label)
LEFT JOIN (SELECT author_id, label, count(*) AS n FROM author_comments GROUP BY ALL) c ON c.author_id = a.author_id AND c.label = l.label""",
       "author_comments")
def _(t):
    return op.complete_grid(t.author_comments, "author_id")


@query("topic_share_join", """
SELECT document, topic, round(gamma, 6) AS gamma, date, round(prop_offense, 6) AS prop_offense
FROM gamma LEFT JOIN shares ON document = video_id""", "gamma shares")
def _(t):
    joined = op.topic_share_join(t.gamma, t.shares.select("video_id", "date", "prop_offense"))
    return rounded(joined, "gamma", "prop_offense")


@query("topic_date_join", """
WITH daily AS (SELECT topic, date, avg(gamma) AS gamma FROM gamma LEFT JOIN shares ON document = video_id GROUP BY topic, date)
SELECT d.topic, d.date, round(d.gamma, 6) AS gamma, e.video_id, round(s.prop_offense, 6) AS prop_offense
FROM daily d LEFT JOIN episodes e ON d.date = e.date LEFT JOIN shares s ON s.video_id = e.video_id AND s.date = d.date""",
       "gamma shares episodes")
def _(t):
    daily = relate.topics_over_time(t.gamma, t.shares).select("topic", "date", "gamma")
    joined = op.topic_date_join(daily, t.episodes.select("video_id", "date"), t.shares)
    return rounded(joined.select("topic", "date", "gamma", "video_id", "prop_offense"), "gamma", "prop_offense")


@query("topic_date_join_video", """
SELECT g.topic, g.document AS video_id, round(g.gamma, 6) AS gamma, e.title, round(s.prop_offense, 6) AS prop_offense
FROM gamma g LEFT JOIN episodes e ON g.document = e.video_id LEFT JOIN shares s ON s.video_id = g.document AND s.date = e.date""",
       "gamma shares episodes")
def _(t):
    dates = t.episodes.select("video_id", "date")
    rows = t.gamma.withColumnRenamed("document", "video_id").join(dates, "video_id")
    joined = op.topic_date_join(rows, t.episodes.select("video_id", "date", "title"), t.shares, on="video_id")
    return rounded(joined.select("topic", "video_id", "gamma", "title", "prop_offense"), "gamma", "prop_offense")


@query("top_terms_join", """
WITH ranked AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta),
terms AS (SELECT topic, string_agg(term, ', ' ORDER BY beta DESC, term) AS terms FROM ranked WHERE r <= 8 GROUP BY topic)
SELECT document, g.topic, terms FROM gamma g LEFT JOIN terms t ON g.topic = t.topic""", "beta gamma")
def _(t):
    return op.left_enrich(t.gamma.select("document", "topic"), top_terms(t.beta, 8), "topic", "topic")
