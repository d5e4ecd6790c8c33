"""Classifier quality: confusion counts, metrics, correction factor, reports.

Every figure comes from counts per (truth, prediction). Those counts are one
map-side combined aggregate over the data; whatever follows works on a handful of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import first_rows, single
from ..functions.wordlists import COARSE_LABELS, FINE_LABELS, OFFENSE
from .aggregates import histogram, share_of_total

CELLS = ("true_positives", "false_negatives", "false_positives", "true_negatives")
METRICS = (
    "sensitivity", "specificity", "pos_pred_value", "neg_pred_value", "precision", "recall", "f1",
    "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy",
)


def _cell_tests(truth: Column, predicted: Column, positive: str) -> dict[str, Column]:
    is_true, is_called = truth == positive, predicted == positive
    tests = (is_true & is_called, is_true & ~is_called, ~is_true & is_called, ~is_true & ~is_called)
    return dict(zip(CELLS, tests))


def confusion_wide(df: DataFrame, truth: str = "truth", predicted: str = "predicted", positive: str = OFFENSE):
    """One row with the four cells; rows without a prediction are in none of them."""
    tests = _cell_tests(F.col(truth), F.col(predicted), positive)
    return df.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def confusion_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted", positive: str = OFFENSE):
    """``(metric, n, percent)`` for the four cells. A cell that does not occur has n = 0."""
    wide = confusion_wide(df, truth, predicted, positive)
    total = sum((F.col(c) for c in CELLS), F.lit(0))
    rows = [
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"), (F.try_divide(F.col(c), total) * 100).alias("percent"))
        for c in CELLS
    ]
    return wide.select(F.inline(F.array(*rows)))


def _metric_columns() -> dict[str, Column]:
    tp, fn, fp, tn = (F.col(c) for c in CELLS)
    n = tp + fn + fp + tn
    ratio = F.try_divide
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    precision = ratio(tp, tp + fp)
    return {
        "sensitivity": sensitivity,
        "specificity": specificity,
        "pos_pred_value": precision,
        "neg_pred_value": ratio(tn, tn + fn),
        "precision": precision,
        "recall": sensitivity,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "prevalence": ratio(tp + fn, n),
        "detection_rate": ratio(tp, n),
        "detection_prevalence": ratio(tp + fp, n),
        "balanced_accuracy": (sensitivity + specificity) / 2,
    }


def confusion_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted", positive: str = OFFENSE):
    """One row with the eleven figures per positive class; undefined ones are null."""
    wide = confusion_wide(df, truth, predicted, positive)
    return wide.select(*[c.alias(n) for n, c in _metric_columns().items()])


def even_grid(start: float = 0.5, stop: float = 0.9, count: int = 10) -> list[float]:
    return [start + (stop - start) * i / (count - 1) for i in range(count)]


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float] | None = None, direction: str = "<=", positive: str = OFFENSE,
    truth: str = "truth", predicted: str = "predicted", score: str = "score",
) -> DataFrame:
    """The metrics at each threshold.

    A prediction stays positive if its score is at most (``">="``: at least) the
    threshold. Each row only notes how many thresholds let it stay; the counts per that
    number are then unfolded, so the data is not multiplied by the thresholds.
    """
    limits = sorted(thresholds or even_grid(), reverse=direction == ">=")
    grid = F.array(*[F.lit(float(t)) for t in limits])
    stays = (lambda t: F.col(score) <= t) if direction == "<=" else (lambda t: F.col(score) >= t)
    passed = F.size(F.filter(grid, stays))
    passed = F.when(F.col(predicted) == positive, passed).otherwise(0)
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    counts = known.groupBy((F.col(truth) == positive).alias("is_true"), passed.alias("passed")).agg(
        F.count("*").alias("n")
    )
    per_limit = counts.select("is_true", "passed", "n", F.posexplode(grid).alias("at", "threshold"))
    called = F.col("passed") >= F.size(grid) - F.col("at")
    tests = (F.col("is_true") & called, F.col("is_true") & ~called, ~F.col("is_true") & called, ~F.col("is_true") & ~called)
    cells = [F.sum(F.when(t, F.col("n")).otherwise(0)).alias(c) for c, t in zip(CELLS, tests)]
    wide = per_limit.groupBy("threshold").agg(*cells)
    return wide.select("threshold", *[c.alias(n) for n, c in _metric_columns().items()])


def score_histogram_by_truth(df: DataFrame, bins: int = 30, truth: str = "truth", predicted: str = "predicted"):
    """Distribution of scores per prediction and truth."""
    complete = df.na.drop(subset=[truth, predicted, "score"])
    return histogram(complete, "score", bins, by=(predicted, truth))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Number and share of each label, rows without one left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return share_of_total(counts, output="share", scale=1.0)


def correction_factor(df: DataFrame, truth: str = "truth", predicted: str = "predicted", positive: str = OFFENSE):
    """One row: truly positive rows per row called positive."""
    tp, fn, fp, _ = (F.col(c) for c in CELLS)
    wide = confusion_wide(df, truth, predicted, positive)
    return wide.select(F.try_divide(tp + fn, tp + fp).alias("factor"))


def resampled_correction(
    df: DataFrame, replicates: int = 2500, size: int = 40, seed: int = 42, replacement: bool = False,
    truth: str = "truth", predicted: str = "predicted", positive: str = OFFENSE,
) -> DataFrame:
    """``(replicate, factor)`` from simple random samples of ``size`` annotated rows.

    A factor depends on a sample only through its four cell counts, so sampling works
    on the counts: draw after draw, a row of a cell is taken with the chance that cell
    still has. That is the same distribution as drawing rows, and its cost does not grow
    with the number of annotated rows. The draws are hashes of (seed, replicate, draw),
    hence repeatable.
    """
    tests = _cell_tests(F.col(truth), F.col(predicted), positive)
    cells = [F.count_if(t).cast("double").alias(c) for c, t in tests.items()]
    counts = single(df.agg(F.struct(*cells, F.count("*").cast("double").alias("rows")).alias("counts")))
    runs = df.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"), counts.alias("c"))
    tp, fn, fp, tn = (F.col(f"c.{c}") for c in CELLS)

    def uniform(draw: Column) -> Column:
        text = F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string"), draw.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    draws = F.sequence(F.lit(1), F.lit(size) if replacement else F.least(F.lit(size), F.col("c.rows").cast("int")))
    runs = runs.where(F.col("c.rows") > 0).select("replicate", "c", F.transform(draws, uniform).alias("draws"))

    def take(state: Column, u: Column) -> Column:
        # p1..p4 are left to draw per cell, a row without prediction makes up the rest
        left = [state[f"p{i}"] for i in range(1, 5)]
        mark = u * state["rows"]
        upto = [sum(left[:i], F.lit(0.0)) for i in range(1, 5)]
        hit = [mark < upto[0], *[(mark >= upto[i - 1]) & (mark < upto[i]) for i in range(1, 4)]]
        one = [h.cast("double") for h in hit]
        kept = left if replacement else [p - o for p, o in zip(left, one)]
        return F.struct(
            *[p.alias(f"p{i}") for i, p in enumerate(kept, start=1)],
            (state["rows"] - (0.0 if replacement else 1.0)).alias("rows"),
            *[(state[f"g{i}"] + one[i - 1]).alias(f"g{i}") for i in range(1, 4)],
        )

    start = F.struct(
        *[p.alias(f"p{i}") for i, p in enumerate((tp, fn, fp, tn), start=1)], F.col("c.rows").alias("rows"),
        *[F.lit(0.0).alias(f"g{i}") for i in range(1, 4)],
    )
    got = runs.select("replicate", F.aggregate("draws", start, take).alias("s"))
    return got.select("replicate", F.try_divide(F.col("s.g1") + F.col("s.g2"), F.col("s.g1") + F.col("s.g3")).alias("factor"))


def stratified_sample(df: DataFrame, n: int = 125, label: str = "label", key: str = "id") -> DataFrame:
    """``n`` rows per label in a repeatable random order, for annotation.

    The limit is applied within every task before the shuffle, so a label that holds
    most of the table hands on n rows per task.
    """
    order = [F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]
    return first_rows(df, [label], order, n, "__r").drop("__r")


def apply_correction(counts: DataFrame, factors: DataFrame, n: str = "n", label: str = "label") -> DataFrame:
    """Toxic counts corrected by a factor, or by the distribution of several.

    With several factors the corrected count is a multiple of the raw one, so its mean
    and its 2.5 % and 97.5 % points follow from those of the factors: the counts are
    not multiplied by the number of replicates.
    """
    points = F.percentile("factor", F.array(F.lit(0.025), F.lit(0.975)))  # one row per replicate
    spread = single(factors.agg(F.struct(F.avg("factor").alias("mean"), points.alias("points")).alias("spread")))
    corrected = lambda f: F.when(F.col(label) == OFFENSE, F.col(n) * f).otherwise(F.col(n).cast("double"))
    low, high = F.get(spread["points"], 0), F.get(spread["points"], 1)
    return counts.withColumns({"n_mean": corrected(spread["mean"]), "n_low": corrected(low), "n_high": corrected(high)})


def _half_up(value: Column) -> Column:
    return F.floor(value * 100 * 100 + 0.5) / 100


def multiclass_report(df: DataFrame, labels: Sequence[str] = FINE_LABELS, truth: str = "truth", predicted: str = "predicted"):
    """``(category, precision, recall, fscore, accuracy)`` in percent, rounded half up, and
    the numbers ``correct`` and ``total``.

    One row per label and a row AVERAGE, whose F-score is that of the averaged precision
    and recall. Undefined figures count as zero. Accuracy (unrounded) and the numbers are on every row.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hits = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    t, p = F.col("t"), F.coalesce("p", F.lit(""))
    wide = pairs.agg(
        hits(t == p).alias("correct"), hits(F.lit(True)).alias("total"),
        *[hits((t == v) & (p == v)).alias(f"tp{i}") for i, v in enumerate(labels)],
        *[hits((t != v) & (p == v)).alias(f"fp{i}") for i, v in enumerate(labels)],
        *[hits((t == v) & (p != v)).alias(f"fn{i}") for i, v in enumerate(labels)],
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wide = wide.withColumns({
        **{f"pr{i}": zero(F.try_divide(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}"))) for i in range(len(labels))},
        **{f"re{i}": zero(F.try_divide(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fn{i}"))) for i in range(len(labels))},
    })
    mean = lambda kind: sum((F.col(f"{kind}{i}") for i in range(len(labels))), F.lit(0.0)) / len(labels)
    wide = wide.withColumns({"pr_avg": mean("pr"), "re_avg": mean("re")})
    accuracy = (zero(F.try_divide("correct", "total")) * 100).alias("accuracy")

    def line(name: str, suffix: str) -> Column:
        pr, re = F.col(f"pr{suffix}"), F.col(f"re{suffix}")
        f = zero(F.try_divide(2 * pr * re, pr + re))
        return F.struct(
            F.lit(name).alias("category"), _half_up(pr).alias("precision"),
            _half_up(re).alias("recall"), _half_up(f).alias("fscore"), accuracy, "correct", "total",
        )

    lines = [line(v, str(i)) for i, v in enumerate(labels)] + [line("AVERAGE", "_avg")]
    return wide.select(F.inline(F.array(*lines)))


def validate_predictions(
    predictions: DataFrame, gold: DataFrame, line: str = "line", columns: int = 3,
    domains: Mapping[int, Sequence[str]] | None = None,
) -> DataFrame:
    """``(file, rule, detail, n)``: what is wrong with two tab-separated files, empty if
    nothing is. Both files are checked once, for equal and non-zero numbers of rows, for
    the number of columns, and for labels outside the domain of their column."""
    domains = domains or {1: COARSE_LABELS, 2: FINE_LABELS}
    files = {"predictions": predictions, "gold": gold}
    found = []
    for name, df in files.items():
        cells = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), "\t")
        parsed = df.select(cells.alias("cells"))
        width = F.size("cells")
        tests = [F.when(width != columns, F.struct(F.lit("columns").alias("rule"), width.cast("string").alias("detail")))]
        for at, domain in domains.items():
            cell = F.coalesce(F.get("cells", at), F.lit(""))
            tests.append(F.when(
                ~cell.isin(list(domain)), F.struct(F.lit(f"label_{at + 1}").alias("rule"), cell.alias("detail"))
            ))
        broken = parsed.select(F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull())))
        found.append(broken.groupBy(F.lit(name).alias("file"), "rule", "detail").agg(F.count("*").alias("n")))
    sizes = predictions.agg(F.count("*").alias("p")).withColumn("g", gold.agg(F.count("*").alias("g")).scalar())
    problem = F.when(F.col("p") != F.col("g"), "row_count").when(F.col("p") == 0, "empty")
    counts = sizes.select(
        F.lit("both").alias("file"), problem.alias("rule"),
        F.concat_ws(" / ", F.col("p").cast("string"), F.col("g").cast("string")).alias("detail"),
        F.lit(1).cast("bigint").alias("n"),
    ).where(F.col("rule").isNotNull())
    return found[0].unionByName(found[1]).unionByName(counts)
