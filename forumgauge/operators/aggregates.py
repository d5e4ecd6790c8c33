"""Counts, shares, quantiles and distributions.

Totals are scalar subqueries over the already aggregated table, never windows, and
per-group totals are aggregates joined back (see ``functions.keys``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import literal_rows, single
from ..functions.ordering import at_positions
from ..functions.wordlists import OFFENSE
from .joins import complete_grid

DECILES = tuple(i / 10 for i in range(1, 11))
TWENTIETHS = tuple(i / 20 for i in range(0, 21))


def count_by(df: DataFrame, *keys: str, sort: bool = False) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), *keys) if sort else out


def entity_counts(df: DataFrame, *entities: str, approximate: bool = False) -> DataFrame:
    """One row: number of rows and of distinct values of each entity column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("n_rows"), *[distinct(e).alias(f"n_{e}") for e in entities])


def sum_mean_views(df: DataFrame, views: str = "view_count") -> DataFrame:
    return df.agg((F.sum(views) / F.lit(1e6)).alias("sum_millions"), F.avg(views).alias("mean_views"))


def label_summary(df: DataFrame, label: str = "label", likes: str = "like_count") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(likes).alias("mean_like_count"))


def completeness_check(episodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows per episode by whether they lack a score; an episode without any scored
    comment counts as one row that lacks it."""
    counted = scores.groupBy("video_id", F.col("score").isNull().alias("na_score")).agg(F.count("*").alias("n"))
    joined = episodes.groupBy("video_id").agg(F.count("*").alias("rows")).join(counted, "video_id", "left")
    found = joined.select("video_id", F.coalesce("na_score", F.lit(True)).alias("na_score"), (F.col("rows") * F.coalesce("n", F.lit(1))).alias("n"))
    return found.groupBy("video_id", "na_score").agg(F.sum("n").alias("n"))


def coverage_ratio(analysed: DataFrame, episodes: DataFrame, reported: str = "comment_count") -> DataFrame:
    """Analysed rows, rows the platform reports, and their ratio."""
    total = episodes.agg(F.sum(reported).cast("bigint").alias("n"))
    return analysed.agg(F.count("*").alias("n_analysed")).select(
        "n_analysed",
        single(total).alias("n_reported"),
        F.try_divide("n_analysed", single(total)).alias("coverage"),
    )


def quantile_table(
    df: DataFrame, column: str, probabilities: Sequence[float] = DECILES, method: str = "exact", accuracy: int = 10000
) -> DataFrame:
    """``(prob, value)`` with linear interpolation between neighbours.

    The exact method counts each distinct value, orders the counts in blocks and
    picks the values at the wanted positions, so no task sees the whole column.
    ``method="approx"`` trades exactness for a single pass.
    """
    values = df.where(F.col(column).isNotNull())
    if method == "approx":
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        found = values.agg(F.percentile_approx(column, list(map(float, probabilities)), accuracy).alias("v"))
        pairs = F.arrays_zip(probs.alias("prob"), F.col("v").cast("array<double>").alias("value"))
        return found.select(F.inline(pairs)).toDF("prob", "value")
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    counts = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    uses: list[tuple[int, str, float, float]] = []  # filled once the number of values is known

    def wanted(total: int) -> list[int]:
        for p in map(float, probabilities if total else ()):
            h = (total - 1) * p
            uses.extend([(math.floor(h), "low", p, h - math.floor(h)), (math.ceil(h), "high", p, h - math.floor(h))])
        return [use[0] for use in uses]

    found = at_positions(counts, F.col("n"), [F.col("v").asc()], wanted).select("position", "v")
    names = ("position", "side", "prob", "part")
    sides = literal_rows(df.sparkSession, names, uses, "position bigint, side string, prob double, part double")
    low, high = (F.max(F.when(F.col("side") == side, F.col("v"))) for side in ("low", "high"))
    return found.join(F.broadcast(sides), "position").groupBy("prob", "part").agg(low.alias("low"), high.alias("high")).select(
        "prob", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value")
    )


def quantile_lookup(quantiles: DataFrame, zero: float = 0.0, targets: Sequence[float] = (50.0, 100.0)) -> DataFrame:
    """From a quantile table: the largest quantile still at ``zero`` and the smallest at
    each target value, in percent (null where none)."""
    percent = F.col("prob") * 100
    return quantiles.agg(
        F.max(F.when(F.col("value") == zero, percent)).alias("max_at_zero"),
        *[F.min(F.when(F.col("value") == t, percent)).alias(f"min_at_{t:g}") for t in targets],
    )


def share_of_total(df: DataFrame, n: str = "n", output: str = "percent", scale: float = 100.0) -> DataFrame:
    """Value as percent of the grand total."""
    total = df.agg(F.sum(n).alias("total"))
    return df.withColumn(output, F.try_divide(n, single(total)) * F.lit(scale))


def toxic_share(
    df: DataFrame,
    factor: float | Column = 1.0,
    keys: Sequence[str] = ("video_id", "date"),
    scope: str = "group",
    label: str = "label",
) -> DataFrame:
    """Corrected number of toxic rows per episode and its share in percent.

    ``scope="group"`` relates it to the rows of the same episode, ``"global"`` to all
    rows. Only episodes with toxic rows appear.
    """
    factor = F.lit(float(factor)) if isinstance(factor, (int, float)) else factor
    toxic = F.col(label) == OFFENSE
    counts = df.groupBy(*keys).agg(F.count_if(toxic).alias("__toxic"), F.count("*").alias("__all"))
    corrected = F.col("__toxic") * factor
    counts = counts.withColumns({"n": corrected, "__sum": corrected + (F.col("__all") - F.col("__toxic"))})
    if scope == "group":
        base: Column = F.col("__sum")
    elif scope == "global":
        base = single(counts.agg(F.sum("__sum").alias("total")))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return counts.where(F.col("__toxic") > 0).select(
        *keys, F.lit(OFFENSE).alias("label"), "n", (F.try_divide("n", base) * 100).alias("prop_offense")
    )


def toxic_total(shares: DataFrame) -> DataFrame:
    return shares.agg(F.sum("n").alias("sum_toxic"))


def mean_toxic_share(shares: DataFrame) -> DataFrame:
    return shares.agg(F.avg("prop_offense").alias("mean_prop_offense"))


def author_activity(df: DataFrame, author: str = "author_id") -> DataFrame:
    """Comments per author and percent of all comments."""
    return share_of_total(count_by(df, author))


def author_toxic_activity(df: DataFrame, author: str = "author_id", label: str = "label") -> DataFrame:
    """Toxic comments per author (of those with any) and percent of all toxic ones."""
    return author_activity(df.where(F.col(label) == OFFENSE), author)


def author_toxic_share(df: DataFrame, author: str = "author_id", label: str = "label") -> DataFrame:
    """Toxic comments of every author, zero included, and percent of that author's own
    (labelled) comments. One conditional aggregate."""
    labelled = df.groupBy(author).agg(
        F.count_if(F.col(label) == OFFENSE).alias("n"), F.count(label).alias("__all")
    )
    return labelled.withColumn("prop_offense", F.try_divide("n", "__all") * 100).drop("__all")


def toxic_grid(df: DataFrame, author: str = "author_id") -> DataFrame:
    """Zero-filled toxic counts per author."""
    return complete_grid(df, author).where(F.col("label") == OFFENSE)


def threshold_share(df: DataFrame, n: str = "n", above: int = 3) -> DataFrame:
    """How many rows exceed a count, and what share that is."""
    split = df.groupBy((F.col(n) > above).alias("above")).agg(F.count("*").alias("n"))
    return share_of_total(split, output="share", scale=1.0)


def weekly_frequency(df: DataFrame, timestamp: str = "published_at") -> DataFrame:
    """Rows per calendar week, weeks starting on Sunday."""
    day = F.to_date(timestamp)
    sunday = F.date_sub(F.date_trunc("week", F.date_add(day, 1)).cast("date"), 1)
    return df.groupBy(sunday.alias("year_week")).agg(F.count("*").alias("n"))


def monthly_mean_frequency(df: DataFrame, timestamp: str = "published_at") -> DataFrame:
    """Mean weekly count per month of the week's first day."""
    weeks = weekly_frequency(df, timestamp)
    month = F.trunc("year_week", "month").alias("year_month")
    return weeks.groupBy(month).agg(F.avg("n").alias("mean_publication_frequency"))


def histogram(
    df: DataFrame, column: str, bins: int | None = 30, width: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per bin, optionally per class: ``(*by, bin, bin_start, n)``.

    With ``width`` bins start at multiples of it; otherwise ``bins`` equal bins span
    the range and the maximum falls into the last one.
    """
    value = F.col(column).cast("double")
    known = df.where(F.col(column).isNotNull())
    if width is not None:
        start, step = F.lit(0.0), F.lit(float(width))
        number = F.floor(value / step)
    else:
        start = single(known.agg(F.min(value).alias("lo")))
        step = single(known.agg(((F.max(value) - F.min(value)) / bins).alias("step")))
        number = F.least(F.floor(F.coalesce(F.try_divide(value - start, step), F.lit(0.0))), F.lit(bins - 1))
    binned = known.groupBy(*by, number.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return binned.select(*by, "bin", (start + F.col("bin") * step).alias("bin_start"), "n")


#: Cells of the grid onto which ``density`` bins its values.
DENSITY_CELLS = 8192


def density(df: DataFrame, column: str, points: int = 512, bandwidth: float | None = None, log10: bool = False):
    """Gaussian kernel density on an even grid from minimum to maximum.

    Values are binned onto a finer grid of ``DENSITY_CELLS`` cells with linear weights, as is
    usual for such estimates; only bins and points are multiplied, whatever the number of values. Without ``bandwidth`` the usual
    rule 0.9 * min(sd, IQR / 1.34) * n^(-1/5) is applied. A column of equal values has no
    density (null).
    """
    known = df.where(F.col(column).isNotNull())
    if log10:
        known = known.where(F.col(column) > 0)
    value = F.col(column).cast("double")
    value = F.log10(value) if log10 else value
    span = known.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    if bandwidth is None:
        moments = known.agg(F.stddev(value).alias("sd"), F.count("*").alias("m"))
        quartiles = quantile_table(known.select(value.alias("x")), "x", (0.25, 0.75))
        iqr = single(quartiles.agg((F.max("value") - F.min("value")).alias("iqr")))
        rule = F.lit(0.9) * F.least(F.col("sd"), iqr / 1.34) * F.pow(F.col("m"), F.lit(-0.2))
        h: Column = single(moments.select(rule.alias("h")))
    else:
        h = F.lit(float(bandwidth))
    lo, hi = single(span.select("lo")), single(span.select("hi"))
    place = F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.0)) * DENSITY_CELLS
    cell = F.floor(place)
    sums = known.groupBy(cell.alias("cell")).agg(F.sum(place - cell).alias("up"), F.count("*").alias("n"))
    shares = F.array(
        F.struct(F.col("cell"), (F.col("n") - F.col("up")).alias("n")), F.struct((F.col("cell") + 1).alias("cell"), F.col("up").alias("n")),
    )
    counts = sums.select(F.explode(shares).alias("s")).groupBy("s.cell").agg(F.sum("s.n").alias("n")).where("n > 0")
    counts = counts.select((lo + (hi - lo) * F.col("cell") / DENSITY_CELLS).alias("x"), "n")
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    at = counts.select("x", "n", grid.alias("i")).withColumn("at", lo + (hi - lo) * F.col("i") / (points - 1))
    kernel = F.sum(F.col("n") * F.exp(-F.pow(F.try_divide(F.col("at") - F.col("x"), h), 2) / 2))
    scale = single(span.select("total")) * h * F.sqrt(F.lit(2.0) * F.pi())
    return at.groupBy("i", "at").agg(F.try_divide(kernel, scale).alias("density"))


def term_total(counts: DataFrame, term: str, word: str = "word") -> DataFrame:
    return counts.where(F.col(word) == term).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def term_ranking(counts: DataFrame, term: str, word: str = "word", document: str = "vid") -> DataFrame:
    """Episodes by how often they use one term."""
    return counts.where(F.col(word) == term).orderBy(F.desc("n"), document)


def mention_timeline(tokens: DataFrame, terms: Sequence[str], word: str = "word", date: str = "date") -> DataFrame:
    """Mentions of chosen words per day, with the square root used as chart height."""
    chosen = tokens.where(F.col(word).isin(list(terms)))
    return count_by(chosen, date, word).withColumn("sqrt_n", F.sqrt("n"))


def term_document_counts(
    terms: DataFrame, tokens: DataFrame, document: str = "vid", term: str = "term", word: str = "word", unused: int = 0,
):
    """How often each of a few terms occurs in each episode; an unused term stays with
    a null episode and the count ``unused`` (the original analysis had 1). Tokens are counted
    before the join."""
    counts = count_by(tokens, document, word)
    joined = terms.select(term).join(counts, F.col(term) == F.col(word), "left")
    return joined.select(term, document, F.coalesce("n", F.lit(unused)).cast("bigint").alias("n"))
