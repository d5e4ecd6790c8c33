"""Queries for projections, filters and scalar columns."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import columns as op
from . import query
from .tables import WORD_SQL


@query("project_columns", """
SELECT url AS link, page_id AS page, length(html) AS n_html FROM pages""")
def _(t):
    pages = t.raw("pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_html"), F.lit(0).alias("thumbnail_width"))
    return op.project_columns(pages, drop_containing="thumbnail", rename={"page_id": "page", "url": "link"}, first=["link"])


@query("filter_title", "SELECT video_id, title, comment_count FROM episodes WHERE title LIKE '%Daily%'", "episodes")
def _(t):
    return op.filter_title(t.episodes, "Daily").select("video_id", "title", "comment_count")


@query("cutoff_filter", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'timestamp' AS compared FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'
UNION ALL
SELECT event_id, CAST(ts AS DATE), 'date' FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'""")
def _(t):
    orders = op.cutoff_filter(t.raw("orders"), "1998-01-01", "o_orderdate")
    events = op.cutoff_filter(t.raw("events"), "2024-01-15", "ts", on="date")
    day = lambda key, ts, how: (F.col(key).alias("o_orderkey"), F.to_date(ts).alias("day"), F.lit(how).alias("compared"))
    return orders.select(*day("o_orderkey", "o_orderdate", "timestamp")).unionByName(events.select(*day("event_id", "ts", "date")))


@query("filter_label", "SELECT id, video_id, round(score, 6) AS score FROM scores WHERE label = 'OFFENSE'", "scores")
def _(t):
    return rounded(op.filter_label(t.scores, "OFFENSE").select("id", "video_id", "score"), "score")


@query("contains_term", "SELECT id, video_id FROM comments WHERE contains(text, 'token')", "comments")
def _(t):
    return op.contains_term(t.comments, "token").select("id", "video_id")


@query("term_occurrences", r"""
SELECT vid, segment_id, 'https://youtu.be/' || CAST(vid AS VARCHAR) || '?t=' || CAST(CAST(floor(start) AS BIGINT) AS VARCHAR) AS link
FROM subtitle_words WHERE word = 'the'""", "subtitle_words")
def _(t):
    return op.term_occurrences(t.subtitle_words, "the").select("vid", "segment_id", "link")


@query("episode_links", """
SELECT video_id, 'https://www.youtube.com/watch?v=' || video_id AS link, video_id AS link_id FROM episodes""", "episodes")
def _(t):
    return op.episode_links(t.episodes.select("video_id"))


@query("calendar_parts", """
SELECT DISTINCT user_id, CAST(ts AS DATE) AS date, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
       CAST(year(ts) AS VARCHAR) || CAST(month(ts) AS VARCHAR) AS year_month FROM events""")
def _(t):
    return op.calendar_parts(t.raw("events"), "user_id", "ts")


@query("like_ratio", """
SELECT video_id, round(CASE WHEN like_count + dislike_count = 0 THEN NULL ELSE like_count / (like_count + dislike_count)::DOUBLE END, 6) AS like_ratio
FROM episodes""", "episodes")
def _(t):
    return rounded(op.like_ratio(t.episodes).select("video_id", "like_ratio"), "like_ratio")


@query("mean_like_ratio", """
SELECT round(avg(CASE WHEN like_count + dislike_count > 0 THEN like_count / (like_count + dislike_count)::DOUBLE END), 6) AS mean_like_ratio
FROM episodes""", "episodes")
def _(t):
    return rounded(op.mean_like_ratio(t.episodes), "mean_like_ratio")


@query("drop_incomplete", """
SELECT c.id, s.label, round(s.score, 6) AS score FROM comments c LEFT JOIN scores s ON c.id = s.id WHERE s.label IS NOT NULL AND s.score IS NOT NULL""",
       "comments scores")
def _(t):
    from ..operators.joins import comments_with_scores

    return rounded(op.drop_incomplete(comments_with_scores(t.comments, t.scores).select("id", "label", "score")), "score")


@query("flag_members", f"""
WITH words AS (SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM conversations) GROUP BY word)
SELECT CASE WHEN word IN ('the', 'der', 'la') THEN '**' || word || '**' ELSE word END AS word, n,
       word IN ('the', 'der', 'la') AS flagged FROM words""")
def _(t):
    from ..operators.aggregates import count_by

    return op.flag_members(count_by(t.subtitle_words, "word"), "word", ("the", "der", "la"))
