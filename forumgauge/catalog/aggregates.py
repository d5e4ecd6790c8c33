"""Queries for counts, shares, quantiles and distributions."""

from pyspark.sql import functions as F

from ..functions.keys import rounded, single
from ..operators import aggregates as op
from ..operators.evaluation import correction_factor
from ..operators.text import explode_term_list, tokenize_words
from ..operators.topics import top_terms
from ..operators.topk import top_episodes
from . import query

AUTHORS_SQL = "WITH authors AS (SELECT author_id, count(*) AS n FROM author_comments GROUP BY author_id)"
TENTHS = ", ".join(str(i / 10) for i in range(1, 11))
TWENTIETHS = ", ".join(str(i / 20) for i in range(0, 21))


@query("count_by", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def _(t):
    return op.count_by(t.raw("documents"), "source", "lang")


@query("entity_counts", """
SELECT count(*) AS n_rows, count(DISTINCT author_id) AS n_author_id, count(DISTINCT video_id) AS n_video_id FROM comments""", "comments")
def _(t):
    return op.entity_counts(t.comments, "author_id", "video_id")


@query("sum_mean_views", """
SELECT round(sum(view_count) / 1e6, 6) AS sum_millions, round(avg(view_count), 6) AS mean_views FROM episodes""", "episodes")
def _(t):
    return rounded(op.sum_mean_views(t.episodes), "sum_millions", "mean_views")


@query("label_summary", """
SELECT label, count(*) AS n, round(avg(like_count), 6) AS mean_like_count FROM scored GROUP BY label""", "scored")
def _(t):
    return rounded(op.label_summary(t.scored), "mean_like_count")


@query("completeness_check", """
WITH e AS (SELECT video_id FROM episodes UNION ALL SELECT 'unscored-' || video_id FROM episodes)
SELECT e.video_id, score IS NULL AS na_score, count(*) AS n FROM e
LEFT JOIN (SELECT video_id, CASE WHEN CAST(id AS BIGINT) % 5 > 0 THEN score END AS score FROM scores) s ON e.video_id = s.video_id GROUP BY 1, 2""", "episodes scores")
def _(t):
    # some scores are missing, and every episode has a twin without scores
    ids = t.episodes.select("video_id")
    both = ids.unionByName(ids.select(F.concat(F.lit("unscored-"), "video_id").alias("video_id")))
    return op.completeness_check(both, t.scores.select("video_id", F.when(F.col("id") % 5 > 0, F.col("score")).alias("score")))


@query("completeness_check_comments", """
SELECT c.video_id, score IS NULL AS na_score, count(*) AS n FROM (SELECT id AS video_id FROM comments) c
LEFT JOIN (SELECT id AS video_id, score FROM scores) s ON c.video_id = s.video_id GROUP BY 1, 2""", "comments scores")
def _(t):
    # one row per comment, so that some have no score
    scores = t.scores.select(F.col("id").alias("video_id"), "score")
    return op.completeness_check(t.comments.select(F.col("id").alias("video_id")), scores)


@query("coverage_ratio", """
SELECT (SELECT count(*) FROM scored) AS n_analysed, CAST(sum(comment_count) AS BIGINT) AS n_reported,
       round((SELECT count(*) FROM scored) / sum(comment_count)::DOUBLE, 6) AS coverage FROM episodes""", "scored episodes")
def _(t):
    return rounded(op.coverage_ratio(t.scored, t.episodes), "coverage")


@query("quantile_table", f"""
SELECT 'views' AS what, unnest([{TENTHS}])::DOUBLE AS prob,
       unnest((SELECT list_transform(quantile_cont(n_chars::DOUBLE, [{TENTHS}]), lambda v: round(v, 6)) FROM documents)) AS value
UNION ALL SELECT 'values', unnest([{TWENTIETHS}])::DOUBLE,
       unnest((SELECT list_transform(quantile_cont(value, [{TWENTIETHS}]), lambda v: round(v, 6)) FROM events))""")
def _(t):
    views = op.quantile_table(t.raw("documents"), "n_chars").withColumn("what", F.lit("views"))
    values = op.quantile_table(t.raw("events"), "value", op.TWENTIETHS).withColumn("what", F.lit("values"))
    return rounded(views.unionByName(values).select("what", "prob", "value"), "value")


@query("quantile_lookup", f"""
WITH shares AS (SELECT author_id, count(*) FILTER (label = 'OFFENSE') * 100.0::DOUBLE / count(*) AS p FROM scored GROUP BY author_id),
q AS (SELECT unnest([{TWENTIETHS}])::DOUBLE * 100 AS percent, unnest((SELECT quantile_cont(p, [{TWENTIETHS}]) FROM shares)) AS value)
SELECT max(percent) FILTER (value = 0) AS max_at_zero, min(percent) FILTER (value = 50) AS min_at_50, min(percent) FILTER (value = 100) AS min_at_100 FROM q""", "scored")
def _(t):
    shares = op.author_toxic_share(t.scored)
    return op.quantile_lookup(op.quantile_table(shares, "prop_offense", op.TWENTIETHS))


@query("share_of_total", """
SELECT source, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def _(t):
    return rounded(op.share_of_total(op.count_by(t.raw("documents"), "source")), "percent")


FACTOR_SQL = """
factor AS (SELECT (count(*) FILTER (truth = 'OFFENSE'))::DOUBLE / (count(*) FILTER (predicted = 'OFFENSE')) AS f FROM annotated),
counts AS (SELECT video_id, date, count(*) FILTER (label = 'OFFENSE') * f AS n, count(*) FILTER (label <> 'OFFENSE') AS other
           FROM scored, factor GROUP BY video_id, date, f)"""


@query("toxic_share", f"""WITH {FACTOR_SQL}
SELECT video_id, date, 'group' AS scope, round(n, 6) AS n, round(n / (n + other) * 100, 6) AS prop_offense FROM counts WHERE n > 0
UNION ALL SELECT video_id, date, 'global', round(n, 6), round(n / (SELECT sum(n + other) FROM counts) * 100, 6) FROM counts WHERE n > 0""",
       "annotated scored")
def _(t):
    factor = single(correction_factor(t.annotated))
    both = [op.toxic_share(t.scored, factor, scope=s).withColumn("scope", F.lit(s)) for s in ("group", "global")]
    return rounded(both[0].unionByName(both[1]).drop("label"), "n", "prop_offense")


@query("toxic_total", f"WITH {FACTOR_SQL} SELECT round(sum(n), 6) AS sum_toxic FROM counts", "annotated scored")
def _(t):
    factor = single(correction_factor(t.annotated))
    return rounded(op.toxic_total(op.toxic_share(t.scored, factor)), "sum_toxic")


@query("mean_toxic_share", f"""WITH {FACTOR_SQL}
SELECT round(avg(n / (n + other) * 100), 6) AS mean_prop_offense FROM counts WHERE n > 0""", "annotated scored")
def _(t):
    factor = single(correction_factor(t.annotated))
    return rounded(op.mean_toxic_share(op.toxic_share(t.scored, factor)), "mean_prop_offense")


@query("author_activity", f"""{AUTHORS_SQL}
SELECT author_id, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM authors""", "author_comments")
def _(t):
    return rounded(op.author_activity(t.author_comments), "percent")


@query("author_toxic_activity", """
SELECT author_id, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM author_comments WHERE label = 'OFFENSE' GROUP BY author_id""", "author_comments")
def _(t):
    return rounded(op.author_toxic_activity(t.author_comments), "percent")


@query("author_toxic_share", """
SELECT author_id, count(*) FILTER (label = 'OFFENSE') AS n, round(count(*) FILTER (label = 'OFFENSE') * 100.0::DOUBLE / count(*), 6) AS prop_offense
FROM author_comments GROUP BY author_id""", "author_comments")
def _(t):
    return rounded(op.author_toxic_share(t.author_comments), "prop_offense")


@query("threshold_share", """
WITH toxic AS (SELECT author_id, count(*) AS n FROM scored WHERE label = 'OFFENSE' GROUP BY author_id)
SELECT n > 1 AS above, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM toxic GROUP BY 1""", "scored")
def _(t):
    return rounded(op.threshold_share(op.author_toxic_activity(t.scored), above=1), "share")


@query("weekly_frequency", """
SELECT CAST(date_trunc('week', o_orderdate + INTERVAL 1 DAY) AS DATE) - 1 AS year_week, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    return op.weekly_frequency(t.raw("orders"), "o_orderdate")


@query("monthly_mean_frequency", """
SELECT CAST(date_trunc('month', year_week) AS DATE) AS year_month, round(avg(n), 6) AS mean_publication_frequency FROM (
  SELECT CAST(date_trunc('week', o_orderdate + INTERVAL 1 DAY) AS DATE) - 1 AS year_week, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def _(t):
    return rounded(op.monthly_mean_frequency(t.raw("orders"), "o_orderdate"), "mean_publication_frequency")


@query("histogram", """
WITH r AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars) - min(n_chars)) / 30.0::DOUBLE AS w FROM documents)
SELECT 'bins' AS kind, lang, CAST(least(floor((n_chars - lo) / w), 29) AS BIGINT) AS bin, round(lo + least(floor((n_chars - lo) / w), 29) * w, 6) AS bin_start, count(*) AS n
FROM documents, r GROUP BY ALL
UNION ALL SELECT 'width', lang, CAST(floor(n_chars / 250.0::DOUBLE) AS BIGINT), floor(n_chars / 250.0::DOUBLE) * 250, count(*) FROM documents GROUP BY ALL""")
def _(t):
    documents = t.raw("documents")
    fixed = op.histogram(documents, "n_chars", bins=30, by=["lang"]).withColumn("kind", F.lit("bins"))
    width = op.histogram(documents, "n_chars", width=250, by=["lang"]).withColumn("kind", F.lit("width"))
    return rounded(fixed.unionByName(width).select("kind", "lang", "bin", "bin_start", "n"), "bin_start")


@query("density", f"""{AUTHORS_SQL},
x AS (SELECT n, log10(n::DOUBLE) AS x FROM authors),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS m,
      0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM x),
p AS (SELECT (x - lo) / (hi - lo) * 8192 AS p FROM x, s),
c AS (SELECT cell, sum(n) AS n FROM (SELECT floor(p) AS cell, 1 - (p - floor(p)) AS n FROM p UNION ALL SELECT floor(p) + 1, p - floor(p) FROM p) GROUP BY cell HAVING sum(n) > 0)
SELECT i, round(lo + (hi - lo) * i / 511, 6) AS at,
       round(sum(n * exp(-pow((lo + (hi - lo) * i / 511 - (lo + (hi - lo) * cell / 8192)) / h, 2) / 2)) / (m * h * sqrt(2 * pi())), 6) AS density
FROM (SELECT CAST(unnest(range(512)) AS INT) AS i), s, c GROUP BY i, lo, hi, m, h""", "author_comments")
def _(t):
    authors = op.count_by(t.author_comments, "author_id")
    return rounded(op.density(authors, "n", points=512, log10=True), "at", "density")


@query("term_total", "SELECT CAST(sum(n) AS BIGINT) AS n FROM subtitle_terms WHERE term = 'the'", "subtitle_terms")
def _(t):
    return op.term_total(t.subtitle_terms, "the", word="term")


@query("term_ranking", "SELECT document, term, n FROM subtitle_terms WHERE term = 'the'", "subtitle_terms")
def _(t):
    return op.term_ranking(t.subtitle_terms, "the", word="term", document="document")


@query("mention_timeline", """
SELECT date, word, count(*) AS n, round(sqrt(count(*)), 6) AS sqrt_n
FROM (SELECT DATE '2024-01-01' + CAST(vid AS INT) AS date, word FROM subtitle_words) WHERE word IN ('the', 'der') GROUP BY date, word""",
       "subtitle_words")
def _(t):
    dated = t.subtitle_words.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("vid").cast("int")))
    return rounded(op.mention_timeline(dated, ("the", "der")), "sqrt_n")


@query("term_document_counts", """
WITH top5 AS (SELECT video_id FROM shares QUALIFY rank() OVER (ORDER BY prop_offense DESC) <= 5),
ranked AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta),
terms AS (SELECT DISTINCT term FROM ranked WHERE r <= 8),
c AS (SELECT document AS vid, s.term, s.n FROM source_terms s WHERE document IN (SELECT video_id FROM top5))
SELECT t.term, c.vid, coalesce(c.n, 0) AS n FROM terms t LEFT JOIN c ON t.term = c.term""", "shares beta source_terms")
def _(t):
    terms = explode_term_list(top_terms(t.beta, 8).select("terms"), "terms", "term").distinct()
    worst = top_episodes(t.shares, t.episodes, 5).select("video_id")
    texts = t.comments.select(F.col("video_id"), "text").join(worst, "video_id", "left_semi")
    return op.term_document_counts(terms, tokenize_words(texts).withColumnRenamed("video_id", "vid"))
