"""Queries for order-dependent operators."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators import windows as op
from ..operators.aggregates import author_activity, count_by
from . import query


@query("rolling_mean", """
WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS video_id, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2),
w AS (SELECT *, avg(amount) OVER r AS m, count(*) OVER r AS k FROM daily
      WINDOW r AS (ORDER BY date DESC, video_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
SELECT 'all' AS series, date, video_id, round(CASE WHEN k = 15 THEN m END, 2) AS rolling_mean FROM w
UNION ALL SELECT 'each', date, video_id, round(CASE WHEN count(*) OVER r = 15 THEN avg(amount) OVER r END, 2) FROM daily
WINDOW r AS (PARTITION BY video_id ORDER BY date DESC ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)""")
def _(t):
    daily = t.raw("orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("video_id")).agg(
        F.sum("o_totalprice").alias("amount")
    )
    whole = op.rolling_mean(daily, "amount").withColumn("series", F.lit("all"))
    each = op.rolling_mean(daily, "amount", [F.col("date").desc()], keys=["video_id"]).withColumn("series", F.lit("each"))
    return rounded(whole.unionByName(each).select("series", "date", "video_id", "rolling_mean"), "rolling_mean", digits=2)


@query("rolling_toxic_share", """
SELECT video_id, date, round(CASE WHEN count(*) OVER w = 15 THEN avg(prop_offense) OVER w END, 6) AS rolling_mean
FROM shares WINDOW w AS (ORDER BY date DESC, video_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)""", "shares")
def _(t):
    return rounded(op.rolling_mean(t.shares).select("video_id", "date", "rolling_mean"), "rolling_mean")


@query("cumulative_share", """
WITH a AS (SELECT author_id, count(*) AS n FROM author_comments GROUP BY author_id)
SELECT author_id, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent,
       round(sum(n) OVER (ORDER BY n DESC, author_id ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(n) OVER (), 6) AS cum_percent FROM a""",
       "author_comments")
def _(t):
    counts = author_activity(t.author_comments).select("author_id", "n")
    return rounded(op.cumulative_share(counts), "percent", "cum_percent")


@query("top_n_per_group", """
SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)
QUALIFY rank() OVER (PARTITION BY lang ORDER BY n DESC) <= 3""")
def _(t):
    return op.top_n_per_group(count_by(t.raw("documents"), "lang", "source"), "n", 3, ["lang"])


@query("argmax_rows", """
SELECT 'group' AS scope, lang, doc_id, n_chars FROM documents QUALIFY rank() OVER (PARTITION BY lang ORDER BY n_chars DESC) = 1
UNION ALL SELECT 'table', lang, doc_id, n_chars FROM documents WHERE n_chars = (SELECT max(n_chars) FROM documents)""")
def _(t):
    documents = t.raw("documents").select("lang", "doc_id", "n_chars")
    group = op.argmax_rows(documents, "n_chars", ["lang"]).withColumn("scope", F.lit("group"))
    return group.unionByName(op.argmax_rows(documents, "n_chars").withColumn("scope", F.lit("table")))


@query("share_in_group", """
SELECT source, lang, n, round(n / (sum(n) OVER (PARTITION BY source))::DOUBLE, 6) AS share
FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)""")
def _(t):
    return rounded(op.share_in_group(count_by(t.raw("documents"), "source", "lang"), ["source"]), "share")


@query("row_index", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no FROM events""")
def _(t):
    return op.row_index(t.raw("events").select("event_id", "ts"), [F.col("ts").asc(), F.col("event_id").asc()]).drop("ts")
