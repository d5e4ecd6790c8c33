"""Relating topics to toxicity and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import Z_975
from .joins import topic_date_join, topic_share_join
from .reshape import pivot_wider
from .windows import argmax_rows, top_n_per_group


def prevalence_effects(gamma: DataFrame, covariates: DataFrame, key: str = "video_id") -> DataFrame:
    """Per topic, how its proportion moves with year and month (both in one linear
    model): ``(topic, n, year_effect, month_effect)``.

    Two predictors have a closed form in sums that Spark combines within tasks. An
    effect is null if a predictor does not vary or the two move together.
    """
    joined = topic_share_join(gamma, covariates.select(key, "year", "month"), video=key)
    joined = joined.where(F.col("year").isNotNull() & F.col("month").isNotNull())
    year, month = F.col("year").cast("double"), F.col("month").cast("double")
    cov = F.covar_pop
    sums = joined.groupBy("topic").agg(
        F.count("*").alias("n"), F.var_pop(year).alias("yy"), F.var_pop(month).alias("mm"),
        cov(year, month).alias("ym"), cov("gamma", year).alias("gy"), cov("gamma", month).alias("gm"),
    )
    det = F.col("yy") * F.col("mm") - F.col("ym") * F.col("ym")
    singular = F.abs(det) < 1e-12
    effect = lambda num: F.when(~singular, F.try_divide(num, det))
    return sums.select(
        "topic", "n",
        effect(F.col("gy") * F.col("mm") - F.col("gm") * F.col("ym")).alias("year_effect"),
        effect(F.col("gm") * F.col("yy") - F.col("gy") * F.col("ym")).alias("month_effect"),
    )


def prior_effects(models, spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``(K, topic, *names)``: how the prior mean of each topic moves, on the scale of the softmax, with each covariate of the fit
    (one standard deviation of it), next to its level. One row per topic, so it is made on the driver."""
    rows = [
        (k, topic + 1, *map(float, column)) for k, model in models.items() for topic, column in enumerate(model.effects.T)
    ]
    return spark.createDataFrame(rows, ", ".join(["K int", "topic int", *(f"{n} double" for n in names)]))


def topic_regression(gamma: DataFrame, shares: DataFrame, k: int, terms: DataFrame, target: str = "prop_offense"):
    """Toxic share explained by all topic proportions together.

    ``(term, estimate, std_error, statistic, p_value, topic, terms)``, one row per topic
    and one for the intercept. Proportions sum to one, so the last topic is the base
    level and is reported without an estimate.
    """
    spark = gamma.sparkSession
    names = [f"t_{i}" for i in range(1, k + 1)]
    wide = pivot_wider(gamma, ["document"], "topic", "gamma", range(1, k + 1), "t_").na.fill(0.0, names)
    rows = topic_share_join(wide, shares.select("video_id", target)).where(F.col(target).isNotNull())
    assembled = VectorAssembler(inputCols=names[:-1], outputCol="features").transform(rows)
    model = LinearRegression(
        featuresCol="features", labelCol=target, solver="normal", regParam=0.0, standardization=False
    ).fit(assembled)
    summary = model.summary
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    labels = [*names[:-1], "(Intercept)"]
    table = list(zip(
        labels, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues,
        [*range(1, k), None],
    ))
    table.append((names[-1], None, None, None, None, k))
    tidy = spark.createDataFrame(
        [tuple(float(v) if isinstance(v, float) else v for v in row) for row in table],
        "term string, estimate double, std_error double, statistic double, p_value double, topic int",
    )
    return tidy.join(terms, "topic", "left")


def topic_regression_single(gamma: DataFrame, shares: DataFrame, target: str = "prop_offense") -> DataFrame:
    """Toxic share explained by one topic at a time, all topics in one aggregate."""
    rows = topic_share_join(gamma, shares.select("video_id", target)).where(F.col(target).isNotNull())
    return rows.groupBy("topic").agg(
        F.regr_count(target, "gamma").alias("n"),
        F.regr_slope(target, "gamma").alias("estimate"),
        F.regr_intercept(target, "gamma").alias("intercept"),
        F.regr_r2(target, "gamma").alias("r_squared"),
        F.corr(target, "gamma").alias("correlation"),
    )


def significant_topics(
    coefficients: DataFrame, alpha: float = 0.001, strict: bool = False, positive: bool = False
) -> DataFrame:
    """Topics whose effect is significant, largest effect first."""
    p = F.col("p_value")
    out = coefficients.where((F.col("term") != "(Intercept)") & ((p < alpha) if strict else (p <= alpha)))
    if positive:
        out = out.where(F.col("estimate") > 0)
    return out.orderBy(F.desc("estimate"), "topic")


def topics_over_time(
    gamma: DataFrame, shares: DataFrame, terms: DataFrame | None = None, topics: Sequence[int] | None = None
) -> DataFrame:
    """Mean proportion of each topic per day, with an interval clamped at zero."""
    if topics is not None:
        gamma = gamma.where(F.col("topic").isin(list(topics)))
    daily = topic_share_join(gamma, shares.select("video_id", "date")).groupBy("topic", "date").agg(
        F.count("*").alias("n"), F.avg("gamma").alias("gamma")
    )
    half = F.lit(Z_975) * F.col("gamma") / F.sqrt("n")
    daily = daily.withColumns({
        "ci_ll": F.greatest(F.col("gamma") - half, F.lit(0.0)), "ci_ul": F.col("gamma") + half,
    })
    return daily.join(terms, "topic", "left") if terms is not None else daily


def topic_ranking(over_time: DataFrame) -> DataFrame:
    """Topics by the sum of their daily proportions."""
    return over_time.groupBy("topic", "terms").agg(F.sum("gamma").alias("sum_gamma")).orderBy(
        F.desc("sum_gamma"), "topic"
    )


def expected_proportions(gamma: DataFrame, terms: DataFrame, n: int | None = 15) -> DataFrame:
    """Mean proportion of each topic with its top terms, the ``n`` largest."""
    means = gamma.groupBy("topic").agg(F.avg("gamma").alias("gamma"))
    means = top_n_per_group(means, "gamma", n) if n else means
    return means.join(terms, "topic", "left")


def topic_episodes(
    over_time: DataFrame, episodes: DataFrame, shares: DataFrame, topics: Sequence[int],
    above: float = 0.01, on: str = "date",
) -> DataFrame:
    """Episodes in which given topics exceed a proportion, with their toxic share."""
    present = over_time.where(F.col("topic").isin(list(topics)) & (F.col("gamma") > above))
    return topic_date_join(present, episodes, shares, on)


def dominant_topic(gamma: DataFrame, shares: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """The most probable topic of the ``n`` most toxic episodes, with its terms."""
    worst = top_n_per_group(shares, "prop_offense", n).select("video_id", "date", "prop_offense")
    mixed = worst.join(gamma, F.col("video_id") == F.col("document")).drop("document")
    return argmax_rows(mixed, "gamma", ["video_id"]).join(terms, "topic", "left")
