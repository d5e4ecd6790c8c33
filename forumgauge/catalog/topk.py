"""Queries for listings and top lists."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..functions.wordlists import BIGRAM_FILLERS, GERMAN_STOPWORDS
from ..operators import topk as op
from ..plans.comments import toxicity_report
from . import query
from .tables import WORD_SQL

STOP = (*GERMAN_STOPWORDS, *BIGRAM_FILLERS)
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
WATCH = ("of the", "de la", "in the")
WATCH_SQL = ", ".join(f"'{w}'" for w in WATCH)


@query("top_episodes", """
SELECT s.video_id, s.date, round(prop_offense, 6) AS prop_offense, e.title, e.view_count FROM shares s LEFT JOIN episodes e ON s.video_id = e.video_id
QUALIFY rank() OVER (ORDER BY prop_offense DESC) <= 5""", "shares episodes")
def _(t):
    top = op.top_episodes(t.shares, t.episodes, 5)
    return rounded(top.select("video_id", "date", "prop_offense", "title", "view_count"), "prop_offense")


@query("worst_episode_comments", """
SELECT id, video_id, author_id, like_count FROM scored WHERE label = 'OFFENSE' AND video_id IN (SELECT video_id FROM shares WHERE n = (SELECT max(n) FROM shares))""",
       "scored shares")
def _(t):
    return op.worst_episode_comments(t.scored, t.shares, ["id", "video_id", "author_id", "like_count"])


@query("toxic_listing", "SELECT id, author_id, round(score, 6) AS score, like_count, md5(text) AS text_md5 FROM scored WHERE label = 'OFFENSE'", "scored")
def _(t):
    listing = op.toxic_listing(t.scored, ["id", "author_id", "score", "like_count", "text"])
    return rounded(listing.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text"), "score")


BIGRAMS_SQL = f"""
toks AS (SELECT regexp_extract_all(lower(text), '{WORD_SQL}') AS tk FROM scored WHERE label = 'OFFENSE'),
grams AS (SELECT unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS bigram FROM toks WHERE len(tk) > 1),
kept AS (SELECT bigram, count(*) AS n FROM grams WHERE split_part(bigram, ' ', 1) NOT IN ({STOP_SQL}) AND split_part(bigram, ' ', 2) NOT IN ({STOP_SQL}) GROUP BY bigram)"""


@query("toxic_bigrams", f"WITH {BIGRAMS_SQL} SELECT bigram, n FROM kept", "scored")
def _(t):
    return op.toxic_bigrams(t.scored, STOP)


@query("top_bigrams", f"""WITH {BIGRAMS_SQL}
SELECT CASE WHEN bigram IN ({WATCH_SQL}) THEN '**' || bigram || '**' ELSE bigram END AS bigram, n, bigram IN ({WATCH_SQL}) AS flagged
FROM kept QUALIFY rank() OVER (ORDER BY n DESC) <= 15""", "scored")
def _(t):
    return op.top_bigrams(t.scored, STOP, watchlist=WATCH)


@query("sort_by", "SELECT video_id, round(prop_offense, 6) AS prop_offense FROM shares", "shares")
def _(t):
    return op.sort_by(rounded(t.shares.select("video_id", "prop_offense"), "prop_offense"), "-prop_offense", "video_id")


@query("toxicity_report", """
WITH factor AS (SELECT (count(*) FILTER (truth = 'OFFENSE'))::DOUBLE / (count(*) FILTER (predicted = 'OFFENSE')) AS f FROM annotated),
s AS (SELECT video_id, date, n * f AS n, n * f / (n * f + other) * 100 AS prop_offense FROM factor, (
  SELECT video_id, date, count(*) FILTER (label = 'OFFENSE') AS n, count(*) FILTER (label <> 'OFFENSE') AS other FROM scored GROUP BY video_id, date) WHERE n > 0)
SELECT s.video_id, title, s.date, view_count, round(n, 6) AS n, round(prop_offense, 6) AS prop_offense,
       round(CASE WHEN count(*) OVER w = 15 THEN avg(prop_offense) OVER w END, 6) AS rolling_mean
FROM s LEFT JOIN episodes e ON s.video_id = e.video_id WINDOW w AS (ORDER BY s.date DESC, s.video_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)""",
       "annotated scored episodes")
def _(t):
    return toxicity_report(t.episodes, t.scores, t.comments, t.annotated)
