"""Queries for document-term tables, topic models and their relation to toxicity."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rounded, single
from ..functions.wordlists import COMMENT_FILLERS
from ..operators import relate as rel
from ..operators import terms as dt
from ..operators import topics as op
from ..operators.aggregates import count_by
from ..operators.windows import top_n_per_group
from ..plans.topics import compare_topic_numbers, prepare, topics_and_toxicity
from ..session import written
from . import query
from .tables import LANGUAGES, WORD_SQL

K = len(LANGUAGES)
ITERATIONS = 200
# Passes end when no objective grows by more than this share of itself.
TOLERANCE = 1e-4
TERMS_SQL = """
terms AS (SELECT topic, string_agg(term, ', ' ORDER BY beta DESC, term) AS terms
          FROM (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta) WHERE r <= 8 GROUP BY topic)"""


@query("doc_term_counts", "SELECT document, term, n FROM subtitle_terms", "subtitle_terms")
def _(t):
    return t.subtitle_terms


@query("trim_terms", """
SELECT document, term, n FROM document_terms WHERE term IN (
  SELECT term FROM document_terms GROUP BY term HAVING count(*) >= (1 - 0.94::DOUBLE) * (SELECT count(DISTINCT document) FROM document_terms))""",
       "document_terms")
def _(t):
    return dt.trim_terms(t.document_terms, 0.94).select("document", "term", "n")


@query("to_sparse_vectors", """
SELECT document, term, n FROM subtitle_terms WHERE term IN (
  SELECT term FROM subtitle_terms GROUP BY term HAVING count(*) >= (1 - 0.7::DOUBLE) * (SELECT count(DISTINCT document) FROM subtitle_terms))""",
       "subtitle_terms")
def _(t):
    counts = written(dt.trim_terms(t.subtitle_terms, 0.7))
    vocab = dt.vocabulary(counts)
    return dt.from_sparse_vectors(dt.to_sparse_vectors(counts, vocab), vocab)


@query("tf_idf", """
WITH w AS (SELECT document, term, n, n / (sum(n) OVER (PARTITION BY document))::DOUBLE AS tf, count(*) OVER (PARTITION BY term) AS df FROM subtitle_terms),
x AS (SELECT *, tf * ln((SELECT count(DISTINCT document) FROM subtitle_terms)::DOUBLE / df) AS tf_idf FROM w)
SELECT document, term, n, round(tf, 6) AS tf, round(tf_idf, 6) AS tf_idf FROM x""", "subtitle_terms")
def _(t):
    return rounded(dt.tf_idf(t.subtitle_terms, top=None).drop("idf"), "tf", "tf_idf")


@query("tf_idf_top", """
WITH w AS (SELECT document, term, n, n / (sum(n) OVER (PARTITION BY document))::DOUBLE AS tf, count(*) OVER (PARTITION BY term) AS df FROM source_terms),
x AS (SELECT *, tf * ln((SELECT count(DISTINCT document) FROM source_terms)::DOUBLE / df) AS tf_idf FROM w)
SELECT document, term, n, round(tf_idf, 6) AS tf_idf FROM x QUALIFY rank() OVER (PARTITION BY document ORDER BY tf_idf DESC) <= 5""", "source_terms")
def _(t):
    return rounded(dt.tf_idf(t.source_terms).select("document", "term", "n", "tf_idf"), "tf_idf")


@query("toxic_comment_words", f"""
WITH worst AS (SELECT video_id FROM shares QUALIFY rank() OVER (ORDER BY prop_offense DESC) <= 5),
texts AS (SELECT DISTINCT video_id, text FROM scored WHERE label = 'OFFENSE' AND video_id IN (SELECT video_id FROM worst))
SELECT video_id, word, count(*) AS n FROM (SELECT video_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM texts) GROUP BY video_id, word""",
       "scored shares")
def _(t):
    worst = top_n_per_group(t.shares, "prop_offense", 5)
    return count_by(dt.toxic_comment_words(t.scored, worst), "video_id", "word")


@query("top_terms", f"WITH {TERMS_SQL} SELECT topic, terms FROM terms", "beta")
def _(t):
    return op.top_terms(t.beta, 8)


@query("semantic_coherence", """
WITH lead AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY beta DESC, term) AS r FROM beta QUALIFY r <= 10),
p AS (SELECT a.topic, a.term AS ti, b.term AS tj FROM lead a JOIN lead b ON a.topic = b.topic AND a.r > b.r),
dj AS (SELECT topic, l.term, count(*) AS n FROM lead l JOIN document_terms d ON l.term = d.term GROUP BY topic, l.term),
dij AS (SELECT topic, ti, tj, count(*) AS n FROM p JOIN document_terms x ON x.term = ti JOIN document_terms y ON y.term = tj AND x.document = y.document GROUP BY ALL)
SELECT p.topic, round(sum(ln((coalesce(dij.n, 0) + 1)::DOUBLE / dj.n)), 6) AS semantic_coherence
FROM p JOIN dj ON dj.topic = p.topic AND dj.term = p.tj LEFT JOIN dij ON dij.topic = p.topic AND dij.ti = p.ti AND dij.tj = p.tj GROUP BY p.topic""",
       "beta document_terms")
def _(t):
    return rounded(op.semantic_coherence(t.beta, t.document_counts), "semantic_coherence")


@query("exclusivity", """
WITH x AS (SELECT topic, term, beta, round(beta / sum(beta) OVER (PARTITION BY term), 12) AS excl FROM beta),
r AS (SELECT topic, cume_dist() OVER (PARTITION BY topic ORDER BY beta) AS fb, cume_dist() OVER (PARTITION BY topic ORDER BY excl) AS fe,
             row_number() OVER (PARTITION BY topic ORDER BY beta DESC, term) AS rn FROM x)
SELECT topic, round(sum(1 / (0.7 / fe + 0.3 / fb)), 6) AS exclusivity FROM r WHERE rn <= 10 GROUP BY topic""", "beta")
def _(t):
    return rounded(op.exclusivity(t.beta), "exclusivity")


def _heldout_sql(model: str) -> str:
    return f"""
WITH held AS (SELECT * FROM source_terms WHERE ('0x' || substr(md5('42-' || document || '-' || term), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25),
q AS (SELECT h.document, h.term, h.n, sum(g.gamma * b.beta) AS q FROM held h JOIN gamma g ON g.document = h.document
      JOIN {model} b ON b.term = h.term AND b.topic = g.topic GROUP BY h.document, h.term, h.n HAVING sum(g.gamma * b.beta) > 0)
SELECT round(avg(ll), 6) AS heldout_likelihood, CAST(sum(n) AS BIGINT) AS tokens_used, CAST((SELECT sum(n) FROM held) - sum(n) AS BIGINT) AS tokens_skipped
FROM (SELECT document, sum(n * ln(q)) / sum(n) AS ll, sum(n) AS n FROM q GROUP BY document)"""


@query("heldout_likelihood", _heldout_sql("beta"), "source_terms gamma beta")
def _(t):
    _, heldout = op.heldout_split(t.source_terms)
    return rounded(op.heldout_likelihood(heldout, t.gamma, t.beta), "heldout_likelihood")


@query("heldout_likelihood_of_training", _heldout_sql("training_beta"), "source_terms gamma training_beta")
def _(t):
    # the model has not seen the held-out cells, so terms that occur in them alone are skipped
    _, heldout = op.heldout_split(t.source_terms)
    return rounded(op.heldout_likelihood(heldout, t.gamma, t.training_beta), "heldout_likelihood")


@query("residual_dispersion", """
WITH m AS (SELECT document, sum(n)::DOUBLE AS m FROM source_terms GROUP BY document),
q AS (SELECT g.document, b.term, sum(g.gamma * b.beta) AS q FROM gamma g JOIN beta b ON b.topic = g.topic GROUP BY g.document, b.term),
c AS (SELECT m.m, q.q, coalesce(s.n, 0) AS x FROM q JOIN m ON m.document = q.document LEFT JOIN source_terms s ON s.document = q.document AND s.term = q.term WHERE q.q > 0 AND q.q < 1)
SELECT round(sum(pow(x - m * q, 2) / (m * q * (1 - q))) / (count(*) FILTER (m * q > 0.01)
       - (SELECT count(DISTINCT term) FROM beta) - (SELECT count(*) FROM m) * 3), 6) AS residual_dispersion FROM c""", "source_terms gamma beta")
def _(t):
    return rounded(op.residual_dispersion(t.source_terms, t.gamma, t.beta), "residual_dispersion")


@query("prevalence_effects", """
WITH cov AS (SELECT video_id, year(d) AS y, month(d) AS mo FROM (SELECT video_id, DATE '2023-11-01' + 30 * episode_no AS d FROM episodes)),
s AS (SELECT topic, count(*) AS n, var_pop(y) AS yy, var_pop(mo) AS mm, covar_pop(y, mo) AS ym, covar_pop(gamma, y) AS gy, covar_pop(gamma, mo) AS gm
      FROM gamma JOIN cov ON document = video_id GROUP BY topic)
SELECT topic, n, round(CASE WHEN abs(yy * mm - ym * ym) >= 1e-12 THEN (gy * mm - gm * ym) / (yy * mm - ym * ym) END, 6) AS year_effect,
       round(CASE WHEN abs(yy * mm - ym * ym) >= 1e-12 THEN (gm * yy - gy * ym) / (yy * mm - ym * ym) END, 6) AS month_effect FROM s""", "gamma episodes")
def _(t):
    day = F.date_add(F.lit("2023-11-01").cast("date"), F.col("episode_no") * 30)
    covariates = t.episodes.select("video_id", F.year(day).alias("year"), F.month(day).alias("month"))
    return rounded(rel.prevalence_effects(t.gamma, covariates), "year_effect", "month_effect")


def _estimates_sql(more: str = " FROM lines", first: str = "") -> str:
    """Least squares with three predictors by Cramer's rule on their covariances."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    sums = ", ".join(f"covar_pop(t_{i}, t_{j}) AS c{i}{j}" for i, j in pairs)
    sums += ", " + ", ".join(f"covar_pop(t_{i}, y) AS d{i}, avg(t_{i}) AS x{i}" for i in (1, 2, 3))

    def minor(i: int, j: int) -> str:
        (a, b), (c, d) = [r for r in (1, 2, 3) if r != i], [r for r in (1, 2, 3) if r != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}(c{a}{c} * c{b}{d} - c{a}{d} * c{b}{c})"

    inverse = ", ".join(f"{minor(j, i)} / det AS v{i}{j}" for i, j in pairs)
    slopes = ", ".join(f"v{i}1 * d1 + v{i}2 * d2 + v{i}3 * d3 AS b{i}" for i in (1, 2, 3))
    spread = " + ".join(f"x{i} * x{j} * v{i}{j}" for i, j in pairs)
    lines = " UNION ALL ".join(
        f"SELECT 't_{i}' AS term, {i} AS topic, b{i} AS e, sqrt(s2 * v{i}{i} / n) AS se FROM fit" for i in (1, 2, 3)
    )
    return f"""WITH {first}wide AS (SELECT document, max(prop_offense) AS y, {", ".join(f"max(gamma) FILTER (topic = {i}) AS t_{i}" for i in (1, 2, 3))}
  FROM gamma JOIN shares ON document = video_id GROUP BY document),
m AS (SELECT count(*) AS n, avg(y) AS my, var_pop(y) AS vy, {sums} FROM wide),
inv AS (SELECT *, {inverse} FROM (SELECT *, c11 * {minor(1, 1)} + c12 * {minor(1, 2)} + c13 * {minor(1, 3)} AS det FROM m)),
fit AS (SELECT *, n * (vy - b1 * d1 - b2 * d2 - b3 * d3) / (n - 4) AS s2 FROM (SELECT *, {slopes} FROM inv)),
lines AS ({lines} UNION ALL SELECT '(Intercept)', NULL, my - b1 * x1 - b2 * x2 - b3 * x3, sqrt(s2 * (1 + {spread}) / n) FROM fit
  UNION ALL SELECT 't_4', 4, NULL, NULL)
SELECT lines.term, lines.topic, round(e, 4) AS estimate, round(se, 4) AS std_error, round(e / se, 4) AS statistic{more}"""


# Two-sided p of Student's t with n - 4 degrees of freedom: shares of the integral of cos^(n - 5), whose steps SQL adds up.
P_SQL = """, round(list_sum(list_transform(range(20000), lambda i: pow(cos(a + (pi() / 2 - a) * (i + 0.5) / 20000), n - 5))) * (pi() / 2 - a)
  / list_sum(list_transform(range(20000), lambda i: pow(cos(pi() / 2 * (i + 0.5) / 20000), n - 5))) / (pi() / 2), 4) AS p_value, terms
FROM (SELECT lines.*, fit.n, atan(abs(e / se) / sqrt(fit.n - 4)) AS a FROM lines, fit) lines LEFT JOIN terms ON terms.topic = lines.topic"""


@query("topic_regression_estimates", _estimates_sql(), "gamma shares")
def _(t):
    table = rel.topic_regression(t.gamma, t.shares, K, op.top_terms(t.beta, 10))
    return rounded(table.drop("terms", "p_value"), "estimate", "std_error", "statistic", digits=4)


TEN_TERMS_SQL = TERMS_SQL.replace("r <= 8", "r <= 10").strip() + ",\n"


@query("topic_regression", _estimates_sql(P_SQL, TEN_TERMS_SQL), "gamma shares beta")
def _(t):
    table = rel.topic_regression(t.gamma, t.shares, K, op.top_terms(t.beta, 10))
    return rounded(table, "estimate", "std_error", "statistic", "p_value", digits=4)


@query("significant_topics_regression", f"""SELECT * FROM ({_estimates_sql(P_SQL, TEN_TERMS_SQL)}) WHERE term <> '(Intercept)' AND p_value < 0.9""", "gamma shares beta")
def _(t):
    table = rel.topic_regression(t.gamma, t.shares, K, op.top_terms(t.beta, 10))
    return rounded(rel.significant_topics(table, alpha=0.9, strict=True), "estimate", "std_error", "statistic", "p_value", digits=4)


SINGLE_SQL = """
one AS (SELECT topic, regr_count(prop_offense, gamma) AS n, regr_slope(prop_offense, gamma) AS estimate, regr_intercept(prop_offense, gamma) AS intercept,
               regr_r2(prop_offense, gamma) AS r_squared, corr(prop_offense, gamma) AS correlation
        FROM gamma JOIN shares ON document = video_id GROUP BY topic)"""


@query("topic_regression_single", f"""WITH {SINGLE_SQL}
SELECT topic, CAST(n AS BIGINT) AS n, round(estimate, 6) AS estimate, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, round(correlation, 6) AS correlation FROM one""",
       "gamma shares")
def _(t):
    single = rel.topic_regression_single(t.gamma, t.shares)
    return rounded(single, "estimate", "intercept", "r_squared", "correlation")


@query("significant_topics", f"""WITH {SINGLE_SQL}
SELECT topic, 't_' || topic AS term, round(estimate, 6) AS estimate, round(1 - r_squared, 6) AS p_value FROM one WHERE 1 - r_squared <= 0.99 AND estimate > 0""",
       "gamma shares")
def _(t):
    # unexplained variance stands in for the p-value
    single = rel.topic_regression_single(t.gamma, t.shares)
    table = single.select(
        "topic", F.concat(F.lit("t_"), F.col("topic").cast("string")).alias("term"), "estimate",
        (1 - F.col("r_squared")).alias("p_value"),
    )
    return rounded(rel.significant_topics(table, alpha=0.99, positive=True), "estimate", "p_value")


DAILY_SQL = f"""{TERMS_SQL},
daily AS (SELECT topic, date, count(*) AS n, avg(gamma) AS gamma FROM gamma LEFT JOIN shares ON document = video_id GROUP BY topic, date)"""


@query("topics_over_time", f"""WITH {DAILY_SQL}
SELECT d.topic, date, n, round(gamma, 6) AS gamma, round(greatest(gamma - 1.959963984540054 * gamma / sqrt(n), 0), 6) AS ci_ll,
       round(gamma + 1.959963984540054 * gamma / sqrt(n), 6) AS ci_ul, terms FROM daily d LEFT JOIN terms t ON d.topic = t.topic""", "gamma beta shares")
def _(t):
    daily = rel.topics_over_time(t.gamma, t.shares, op.top_terms(t.beta, 8))
    return rounded(daily, "gamma", "ci_ll", "ci_ul")


@query("topics_over_time_chosen", f"""WITH {DAILY_SQL}
SELECT d.topic, date, n, round(gamma, 6) AS gamma, terms FROM daily d LEFT JOIN terms t ON d.topic = t.topic WHERE d.topic IN (2, 4)""", "gamma beta shares")
def _(t):
    daily = rel.topics_over_time(t.gamma, t.shares, op.top_terms(t.beta, 8), topics=(2, 4))
    return rounded(daily.select("topic", "date", "n", "gamma", "terms"), "gamma")


@query("topic_ranking", f"""WITH {DAILY_SQL}
SELECT d.topic, terms, round(sum(gamma), 6) AS sum_gamma FROM daily d LEFT JOIN terms t ON d.topic = t.topic GROUP BY d.topic, terms""", "gamma beta shares")
def _(t):
    return rounded(rel.topic_ranking(rel.topics_over_time(t.gamma, t.shares, op.top_terms(t.beta, 8))), "sum_gamma")


@query("expected_proportions", f"""WITH {TERMS_SQL}, m AS (SELECT topic, avg(gamma) AS gamma FROM gamma GROUP BY topic QUALIFY rank() OVER (ORDER BY avg(gamma) DESC) <= 3)
SELECT m.topic, round(gamma, 6) AS gamma, terms FROM m LEFT JOIN terms t ON m.topic = t.topic""", "gamma beta")
def _(t):
    return rounded(rel.expected_proportions(t.gamma, op.top_terms(t.beta, 8), 3), "gamma")


@query("topic_episodes", f"""WITH {DAILY_SQL}
SELECT d.topic, d.date, round(d.gamma, 6) AS gamma, d.n, e.video_id, e.title, round(s.prop_offense, 6) AS prop_offense
FROM daily d LEFT JOIN episodes e ON d.date = e.date LEFT JOIN shares s ON s.video_id = e.video_id AND s.date = d.date
WHERE d.topic IN (1, 3) AND d.gamma > 0.01""", "gamma beta shares episodes")
def _(t):
    daily = rel.topics_over_time(t.gamma, t.shares)
    found = rel.topic_episodes(daily, t.episodes.select("video_id", "date", "title"), t.shares, topics=(1, 3))
    return rounded(found.select("topic", "date", "gamma", "n", "video_id", "title", "prop_offense"), "gamma", "prop_offense")


@query("dominant_topic", f"""WITH {TERMS_SQL},
worst AS (SELECT video_id, date, prop_offense FROM shares QUALIFY rank() OVER (ORDER BY prop_offense DESC) <= 5)
SELECT w.video_id, w.date, round(prop_offense, 6) AS prop_offense, g.topic, round(gamma, 6) AS gamma, terms
FROM worst w JOIN gamma g ON w.video_id = g.document LEFT JOIN terms t ON g.topic = t.topic
QUALIFY rank() OVER (PARTITION BY w.video_id ORDER BY gamma DESC) = 1""", "gamma beta shares")
def _(t):
    return rounded(rel.dominant_topic(t.gamma, t.shares, op.top_terms(t.beta, 8)), "prop_offense", "gamma")


# The trimmed subtitles without held-out cells. What only a fit decides is in the unit tests; here its tables are
# compared as far as SQL can tell: their keys, their sums, and the range of every figure.
TRAINING_SQL = """
trimmed AS (SELECT * FROM subtitle_terms WHERE term IN (SELECT term FROM subtitle_terms GROUP BY term
            HAVING count(*) >= (1 - 0.94::DOUBLE) * (SELECT count(DISTINCT document) FROM subtitle_terms))),
training AS (SELECT * FROM trimmed WHERE ('0x' || substr(md5('42-' || document || '-' || term), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.25),
ks AS (SELECT unnest([10, 15, 20, 25, 30]) AS "K")"""


def _trimmed(t, sparsity=0.94):
    # documents, terms and the trimmed table are three reads of the counts, for which texts are taken apart once
    return written(dt.trim_terms(written(t.subtitle_terms, "counts"), sparsity).select("document", "term", "n"))


def _models(t):
    counts = _trimmed(t)
    training, heldout = (written(part) for part in op.heldout_split(counts))
    vocab = written(dt.vocabulary(training))
    return training, heldout, vocab, op.fit_topics(dt.term_vectors(training, vocab), max_iter=ITERATIONS, tolerance=TOLERANCE)


def _bounds(t, models):
    return reduce(DataFrame.unionByName, [op.model_bound(m, t.spark) for m in models.values()])


# the likelihood of the training cells if all documents had the same words: every model must be better than that
ONE_TOPIC = """(SELECT sum(n * ln(n / total)) FROM (SELECT sum(n)::DOUBLE AS n FROM training GROUP BY term), (SELECT sum(n)::DOUBLE AS total FROM training))"""


@query("fit_topics", f"""WITH {TRAINING_SQL}
SELECT "K", (SELECT count(DISTINCT document) FROM training) AS documents, (SELECT count(DISTINCT term) FROM training) AS terms,
       CAST((SELECT sum(n) FROM training) AS BIGINT) AS tokens, round({ONE_TOPIC}, 4) AS one_topic, true AS better_than_one_topic FROM ks""",
       "subtitle_terms")
def _(t):
    training, _, vocab, models = _models(t)
    per_term = training.groupBy("term").agg(F.sum("n").alias("n"))
    total = single(training.agg(F.sum("n")))
    fit = models[10].fit
    held = fit.slices.select(F.explode("docs").alias("d")).select("d.document", F.explode("d.n").alias("n")).agg(
        F.count_distinct("document").alias("documents"), F.sum("n").cast("bigint").alias("tokens"))
    terms = single(op.topic_terms(models[10], vocab).agg(F.count_distinct("term")))
    one = single(per_term.agg(F.sum(F.col("n") * F.ln(F.col("n") / total))))
    rows = _bounds(t, models).select("K", "bound").crossJoin(held)  # one row of totals
    return rounded(rows.select("K", "documents", terms.alias("terms"), "tokens", one.alias("one_topic"), (F.col("bound") > one).alias("better_than_one_topic")), "one_topic", digits=4)


@query("topic_terms", f"""WITH {TRAINING_SQL}
SELECT "K", CAST(unnest(range(1, "K" + 1)) AS INT) AS topic, (SELECT count(DISTINCT term) FROM training) AS terms, 1.0::DOUBLE AS beta FROM ks""", "subtitle_terms")
def _(t):
    _, _, vocab, models = _models(t)
    table = op.every_topic_terms(models, vocab)
    return rounded(table.groupBy("K", "topic").agg(F.count_distinct("term").alias("terms"), F.sum("beta").alias("beta")), "beta")


@query("topic_docs", f"""WITH {TRAINING_SQL}
SELECT "K", document, CAST("K" AS BIGINT) AS topics, 1.0::DOUBLE AS gamma FROM ks, (SELECT DISTINCT document FROM training)""", "subtitle_terms")
def _(t):
    *_, models = _models(t)
    table = op.every_topic_docs(models)
    return rounded(table.groupBy("K", "document").agg(F.count_distinct("topic").alias("topics"), F.sum("gamma").alias("gamma")), "gamma")


@query("topic_docs_of_others", f"""WITH {TRAINING_SQL}
SELECT "K", document, CAST("K" AS BIGINT) AS topics, 1.0::DOUBLE AS gamma FROM ks,
       (SELECT DISTINCT document FROM trimmed WHERE term IN (SELECT term FROM training) AND (document, term) NOT IN (SELECT (document, term) FROM training))""",
       "subtitle_terms")
def _(t):
    # proportions of texts the models have not seen: the held-out cells
    _, heldout, vocab, models = _models(t)
    table = op.every_topic_docs(models, dt.term_vectors(heldout, vocab))
    return rounded(table.groupBy("K", "document").agg(F.count_distinct("topic").alias("topics"), F.sum("gamma").alias("gamma")), "gamma")


@query("model_bound", f"""WITH {TRAINING_SQL}
SELECT "K", round(lgamma("K" + 1), 6) AS lfact, round(lgamma("K" + 1), 6) AS added, true AS bound_is_negative, true AS within_limit FROM ks""", "subtitle_terms")
def _(t):
    *_, models = _models(t)
    table = _bounds(t, models)
    return rounded(table.select(
        "K", "lfact", (F.col("lbound") - F.col("bound")).alias("added"), (F.col("bound") < 0).alias("bound_is_negative"),
        F.col("iterations").between(1, ITERATIONS).alias("within_limit")), "lfact", "added")


@query("prevalence_fit", """
SELECT "K", topic, true AS is_finite FROM (SELECT "K", CAST(unnest(range(1, "K" + 1)) AS INT) AS topic FROM (SELECT unnest([10, 15]) AS "K"))""")
def _(t):
    # year and month of a subtitle's day move the prior mean of its topics within the fit
    counts = _trimmed(t)
    vocab = written(dt.vocabulary(counts))
    day = F.date_add(F.lit("2023-11-01").cast("date"), (F.col("document") % 700).cast("int"))
    covariates = counts.select("document").distinct().select("document", F.year(day).alias("year"), F.month(day).alias("month"))
    models = op.fit_topics(dt.term_vectors(counts, vocab), (10, 15), ITERATIONS, TOLERANCE, covariates)
    return rel.prior_effects(models, t.spark, ["level", "year", "month"]).select(
        "K", "topic", (~F.isnan(F.col("year") + F.col("month") + F.col("level"))).alias("is_finite"))


METRICS_SQL = """
SELECT CAST(unnest([10, 15, 20, 25, 30]) AS INT) AS "K", metric, true AS in_range
FROM (SELECT unnest(['exclusivity', 'lower_bound', 'residuals', 'semantic_coherence', 'heldout_likelihood']) AS metric)"""


def _in_range(table):
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    limits = (
        F.when(F.col("metric") == "exclusivity", (v > 0) & (v <= 10)).when(F.col("metric") == "residuals", v != 0)
        .when(F.col("metric") == "semantic_coherence", v < 45 * 0.7).otherwise(v < 0)  # 45 pairs of ln 2 at most
    )
    return table.select("K", "metric", (finite & limits).alias("in_range"))


@query("k_diagnostics", METRICS_SQL)
def _(t):
    training, heldout, vocab, models = _models(t)
    return _in_range(op.k_diagnostics(models, vocab, training, heldout))


# Stand-in topics of several K: the words of the sources whose number leaves the same rest.
PER_K_SQL = """
kbeta AS (SELECT "K", topic, term, n / sum(n) OVER (PARTITION BY "K", topic)::DOUBLE AS beta
          FROM (SELECT "K", CAST(substr(document, 4) AS INT) % "K" + 1 AS topic, term, sum(n)::DOUBLE AS n
                FROM source_terms, (SELECT unnest([10, 15, 20, 25, 30]) AS "K") GROUP BY ALL))"""


@query("coherence_vs_exclusivity", f"""WITH {PER_K_SQL},
lead AS (SELECT "K", topic, term, row_number() OVER (PARTITION BY "K", topic ORDER BY beta DESC, term) AS r FROM kbeta QUALIFY r <= 10),
p AS (SELECT a."K", a.topic, a.term AS ti, b.term AS tj FROM lead a JOIN lead b ON a."K" = b."K" AND a.topic = b.topic AND a.r > b.r),
dj AS (SELECT term, count(*) AS n FROM document_terms WHERE term IN (SELECT term FROM lead) GROUP BY term),
dij AS (SELECT ti, tj, count(*) AS n FROM (SELECT DISTINCT ti, tj FROM p) JOIN document_terms x ON x.term = ti JOIN document_terms y ON y.term = tj AND x.document = y.document GROUP BY ALL),
coh AS (SELECT p."K", p.topic, sum(ln((coalesce(dij.n, 0) + 1)::DOUBLE / dj.n)) AS c
  FROM p JOIN dj ON dj.term = p.tj LEFT JOIN dij ON dij.ti = p.ti AND dij.tj = p.tj GROUP BY ALL),
x AS (SELECT "K", topic, term, beta, round(beta / sum(beta) OVER (PARTITION BY "K", term), 12) AS excl FROM kbeta),
r AS (SELECT "K", topic, cume_dist() OVER (PARTITION BY "K", topic ORDER BY beta) AS fb, cume_dist() OVER (PARTITION BY "K", topic ORDER BY excl) AS fe,
             row_number() OVER (PARTITION BY "K", topic ORDER BY beta DESC, term) AS rn FROM x),
ex AS (SELECT "K", topic, sum(1 / (0.7 / fe + 0.3 / fb)) AS e FROM r WHERE rn <= 10 GROUP BY ALL)
SELECT coh."K", coh.topic, round(c, 6) AS semantic_coherence, round(e, 6) AS exclusivity FROM coh JOIN ex ON coh."K" = ex."K" AND coh.topic = ex.topic""",
       "source_terms document_terms")
def _(t):
    counts, per_k = written(t.source_terms, "source-terms"), {}
    for k in op.TOPIC_NUMBERS:
        topic = (F.substring("document", 4, 10).cast("int") % k + 1).alias("topic")
        own = counts.groupBy(topic, "term").agg(F.sum("n").cast("double").alias("n"))
        totals = counts.groupBy(topic).agg(F.sum("n").cast("double").alias("total"))
        per_k[k] = own.join(totals, "topic").select("topic", "term", (F.col("n") / F.col("total")).alias("beta"))
    return rounded(op.coherence_vs_exclusivity(per_k, t.document_counts), "semantic_coherence", "exclusivity")


def _comment_corpus(t):
    texts = t.texts("documents").select(F.col("doc_id").alias("document"), "text")
    return prepare(texts, list(COMMENT_FILLERS), sparsity=0.7)


@query("comment_topics_plan", METRICS_SQL)
def _(t):
    # the whole plan for the comments: words, fillers out, frequent terms, all five numbers of topics, their diagnostics
    return _in_range(compare_topic_numbers(_comment_corpus(t), max_iter=ITERATIONS, tolerance=TOLERANCE)[1])


@query("comment_topics_and_toxicity", """
SELECT '(Intercept)' AS term, NULL::INT AS topic, true AS has_estimate
UNION ALL SELECT 't_' || topic, CAST(topic AS INT), topic < 10 FROM (SELECT unnest(range(1, 11)) AS topic)""")
def _(t):
    corpus = _comment_corpus(t)
    models = op.fit_topics(corpus.vectors, (10,), ITERATIONS, TOLERANCE)
    shares = t.scored.select(
        F.col("id").alias("video_id"), "date", F.when(F.col("label") == "OFFENSE", 100.0).otherwise(0.0).alias("prop_offense"))
    table, _ = topics_and_toxicity(models[10], corpus, shares.select("video_id", "date"), shares, alpha=0.001)
    return table.select("term", "topic", F.col("estimate").isNotNull().alias("has_estimate"))
