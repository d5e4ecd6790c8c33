"""Whole-table order: blocks and chunks must not show in the result."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from forumgauge.functions import ordering
from forumgauge.operators import aggregates as agg
from forumgauge.operators import windows as win


@pytest.fixture(scope="module")
def series(spark):
    # a third of the rows share one date
    rows = [(i, 0 if i % 3 == 0 else i, float(i * 7919 % 101)) for i in range(1000)]
    return spark.createDataFrame(rows, "id int, day int, value double").cache()


def newest_first():
    return [F.col("day").desc(), F.col("id").asc()]


@pytest.mark.parametrize("chunk", [20, 64, 100000])
def test_moving_mean_equals_plain_loop(series, chunk):
    got = ordering.moving_mean(series, "value", newest_first(), 15, "mean", chunk_rows=chunk).toPandas()
    assert len(got) == 1000
    frame = series.toPandas().sort_values(["day", "id"], ascending=[False, True]).reset_index(drop=True)
    frame["want"] = frame["value"][::-1].rolling(15).mean()[::-1]
    both = frame.merge(got[["id", "mean"]], on="id")
    pd.testing.assert_series_equal(both["mean"], both["want"], check_names=False)
    assert both["mean"].isna().sum() == 14


def test_rolling_mean_is_null_on_the_oldest(spark):
    rows = [(f"v{i}", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "video_id string, date int, prop_offense double")
    out = {r["date"]: r["rolling_mean"] for r in win.rolling_mean(df).collect()}
    assert [d for d, m in out.items() if m is None and d < 14].__len__() == 14
    assert out[19] == pytest.approx(sum(range(5, 20)) / 15)


def test_rolling_mean_keeps_series_apart(spark):
    rows = [(k, i, float(i)) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, date int, x double")
    out = ordering.moving_mean(df, "x", [F.col("date").desc()], 15, "m", keys=["k"], chunk_rows=16).collect()
    means = {(r["k"], r["date"]): r["m"] for r in out}
    for k in ("a", "b"):
        assert means[k, 39] == pytest.approx(sum(range(25, 40)) / 15)
        assert all(means[k, d] is None for d in range(14))


def test_position(series):
    got = win.row_index(series, newest_first()).toPandas().sort_values("row_no")
    want = series.toPandas().sort_values(["day", "id"], ascending=[False, True])
    assert got["row_no"].tolist() == list(range(1, 1001))
    assert got["id"].tolist() == want["id"].tolist()


def test_cumulative_share(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "author_id string, n bigint")
    out = [(r["author_id"], r["percent"], r["cum_percent"]) for r in win.cumulative_share(df).orderBy("cum_percent").collect()]
    assert out == [("a", 50.0, 50.0), ("b", 30.0, 80.0), ("c", 20.0, 100.0)]


def test_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, 50.0, None)], "v double")
    out = {r["prob"]: r["value"] for r in agg.quantile_table(df, "v", (0.1, 0.5, 0.9, 0.0, 1.0)).collect()}
    assert out == {0.1: pytest.approx(1.4), 0.5: 3.0, 0.9: pytest.approx(34.0), 0.0: 1.0, 1.0: 50.0}
    rough = agg.quantile_table(df, "v", (0.5,), method="approx").first()
    assert rough["value"] == 3.0


def test_quantiles_of_nothing_and_of_repeats(spark, series):
    empty = series.where("id < 0")
    assert agg.quantile_table(empty, "value").count() == 0
    want = series.toPandas()["value"].quantile([i / 20 for i in range(21)])
    got = {r["prob"]: r["value"] for r in agg.quantile_table(series, "value", agg.TWENTIETHS).collect()}
    assert got == {p: pytest.approx(v) for p, v in want.items()}
    one = spark.createDataFrame([(4.0,)] * 7, "x double")
    assert {r["value"] for r in agg.quantile_table(one, "x").collect()} == {4.0}
    assert agg.density(one, "x", points=8).where("density is not null").count() == 0


def test_top_n_keeps_ties_and_null_groups(spark):
    df = spark.createDataFrame([("x", 5), ("x", 5), ("x", 3), (None, 1), (None, 1), ("y", None)], "g string, v int")
    assert sorted((r["g"] or "", r["v"]) for r in win.top_n_per_group(df, "v", 1, ["g"]).collect()) == [
        ("", 1), ("", 1), ("x", 5), ("x", 5)]
    assert win.top_n_per_group(df, "v", 1).count() == 2
    assert win.top_n_per_group(df, "v", 3).count() == 3
    assert win.top_n_per_group(df, "v", 99).count() == 5


def test_argmax_and_share(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("x", 3), (None, 4)], "g string, n int")
    assert sorted((r["g"] or "", r["n"]) for r in win.argmax_rows(df, "n", ["g"]).collect()) == [("", 4), ("x", 3), ("x", 3)]
    shares = {(r["g"], r["n"]): r["share"] for r in win.share_in_group(df, ["g"]).collect()}
    assert shares[None, 4] == 1.0 and shares["x", 1] == pytest.approx(1 / 7)


def test_limits_apply_before_the_shuffle(series):
    plan = win.top_n_per_group(series, "value", 3, ["day"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_window_over_the_whole_table(series):
    for df in (agg.share_of_total(agg.count_by(series, "day")), win.top_n_per_group(series, "value", 3)):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
