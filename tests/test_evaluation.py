import random

import pytest

from forumgauge.operators import evaluation as ev
from forumgauge.operators import scoring as sc

OFF, OTH = "OFFENSE", "OTHER"


def pairs(spark, tp, fn, fp, tn):
    cells = [(OFF, OFF)] * tp + [(OFF, OTH)] * fn + [(OTH, OFF)] * fp + [(OTH, OTH)] * tn
    return spark.createDataFrame([(i, t, p, 0.5 + i % 40 / 100) for i, (t, p) in enumerate(cells)],
                                 "id int, truth string, predicted string, score double")


def test_missing_cell_counts_zero(spark):
    counts = {r["metric"]: r["n"] for r in ev.confusion_counts(pairs(spark, 3, 2, 0, 5)).collect()}
    assert counts == {"true_positives": 3, "false_negatives": 2, "false_positives": 0, "true_negatives": 5}
    assert ev.confusion_metrics(pairs(spark, 3, 2, 0, 5)).first()["precision"] == 1.0
    assert ev.confusion_metrics(pairs(spark, 0, 0, 0, 5)).first()["sensitivity"] is None
    assert ev.correction_factor(pairs(spark, 0, 2, 0, 5)).first()["factor"] is None


def test_metrics(spark):
    m = ev.confusion_metrics(pairs(spark, 8, 2, 4, 6)).first()
    assert (m["sensitivity"], m["specificity"], m["precision"]) == (0.8, 0.6, pytest.approx(2 / 3))
    assert m["f1"] == pytest.approx(2 * 0.8 * (2 / 3) / (0.8 + 2 / 3))
    assert m["balanced_accuracy"] == pytest.approx(0.7) and m["detection_prevalence"] == 0.6
    assert ev.correction_factor(pairs(spark, 8, 2, 4, 6)).first()["factor"] == pytest.approx(10 / 12)


@pytest.mark.parametrize("direction", ["<=", ">="])
def test_threshold_sweep_equals_one_by_one(spark, direction):
    df = pairs(spark, 30, 10, 20, 40)
    rows = df.collect()
    swept = {round(r["threshold"], 6): r for r in ev.threshold_sweep(df, direction=direction).collect()}
    assert len(swept) == 10
    for t in ev.even_grid():
        stays = lambda s: s <= t if direction == "<=" else s >= t
        called = [(r["truth"] == OFF, r["predicted"] == OFF and stays(r["score"])) for r in rows]
        tp, fp = called.count((True, True)), called.count((False, True))
        want = tp / (tp + fp) if tp + fp else None
        assert swept[round(t, 6)]["precision"] == (pytest.approx(want) if want is not None else None)
        assert swept[round(t, 6)]["recall"] == pytest.approx(tp / 40)


def test_resampling_is_a_simple_random_sample(spark):
    df = pairs(spark, 20, 10, 15, 55)
    got = [r["factor"] for r in ev.resampled_correction(df, 2000, 40).collect()]
    again = [r["factor"] for r in ev.resampled_correction(df, 2000, 40).collect()]
    assert sorted(got) == sorted(again) and len(got) == 2000
    rng, cells = random.Random(1), [0] * 20 + [1] * 10 + [2] * 15 + [3] * 55
    draws = [rng.sample(cells, 40) for _ in range(20000)]
    want = [(d.count(0) + d.count(1)) / (d.count(0) + d.count(2)) for d in draws if d.count(0) + d.count(2)]
    mean = lambda xs: sum(xs) / len(xs)
    sd = lambda xs: mean([(x - mean(xs)) ** 2 for x in xs]) ** 0.5
    assert mean(got) == pytest.approx(mean(want), abs=0.015)
    assert sd(got) == pytest.approx(sd(want), rel=0.1)


def test_resampling_everything_gives_the_factor(spark):
    df = pairs(spark, 8, 2, 4, 6)
    for row in ev.resampled_correction(df, 5, 20).collect() + ev.resampled_correction(df, 5, 999).collect():
        assert row["factor"] == pytest.approx(10 / 12)
    assert ev.resampled_correction(df.limit(0), 5).count() == 0


def test_stratified_sample(spark):
    df = pairs(spark, 50, 0, 0, 3).withColumnRenamed("truth", "label")
    sample = ev.stratified_sample(df, 10)
    assert sample.groupBy("label").count().orderBy("label").collect()[0]["count"] == 10
    assert sample.count() == 13
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_apply_correction(spark):
    counts = spark.createDataFrame([("v", OFF, 10), ("v", OTH, 4)], "video_id string, label string, n bigint")
    factors = spark.createDataFrame([(i, f) for i, f in enumerate([0.5, 0.7, 0.9])], "replicate int, factor double")
    rows = {r["label"]: r for r in ev.apply_correction(counts, factors).collect()}
    assert rows[OFF]["n_mean"] == pytest.approx(7.0) and rows[OTH]["n_high"] == 4.0
    assert rows[OFF]["n_low"] == pytest.approx(5.1)


def test_multiclass_report(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", None)], "truth string, predicted string")
    rows = {r["category"]: r for r in ev.multiclass_report(df, ["A", "B", "C"]).collect()}
    assert (rows["A"]["precision"], rows["A"]["recall"], rows["A"]["fscore"]) == (100.0, 50.0, 66.67)
    assert (rows["C"]["precision"], rows["C"]["fscore"]) == (0.0, 0.0)
    assert rows["AVERAGE"]["precision"] == 50.0 and rows["AVERAGE"]["recall"] == 33.33
    assert rows["AVERAGE"]["fscore"] == 40.0 and rows["A"]["accuracy"] == 50.0


def test_validation(spark):
    lines = lambda *ls: spark.createDataFrame([(line,) for line in ls], "line string")
    good = "text\tOFFENSE\tINSULT"
    rules = lambda p, g: {(r["file"], r["rule"]) for r in ev.validate_predictions(p, g).collect()}
    assert rules(lines(good), lines(good)) == set()
    assert ("predictions", "columns") in rules(lines("text\tOFFENSE"), lines(good))
    assert rules(lines("t\tBAD\tINSULT"), lines(good)) == {("predictions", "label_2")}
    assert rules(lines(good), lines("t\tOTHER\tBAD")) == {("gold", "label_3")}
    assert rules(lines(good, good), lines(good)) == {("both", "row_count")}
    assert rules(lines(good).limit(0), lines(good).limit(0)) == {("both", "empty")}


PORTIONS = "id string, video_id string, group_no int, label string, score double"


def test_combining_mixed_portions(spark):
    df = spark.createDataFrame([("c", "v", 1, OFF, 0.9), ("c", "v", 2, OTH, 0.6)], PORTIONS)
    row = sc.combine_portions(df).first()
    assert (row["label"], row["score"]) == (OFF, pytest.approx(0.65))
    row = sc.combine_portions(df, mode="reference").first()
    assert (row["label"], row["score"]) == (OTH, pytest.approx(0.35))
    rows = {r["group_no"]: r for r in sc.combine_portions_eval(df).collect()}
    assert rows[1]["score"] == pytest.approx(0.9) and rows[2]["score"] == pytest.approx(0.4)
    assert [rows[i]["label"] for i in (1, 2)] == [OFF, OTH]
    with pytest.raises(ValueError):
        sc.combine_portions(df, mode="other")


def test_combining_equal_and_single_portions(spark):
    df = spark.createDataFrame([
        ("a", "v", 1, OFF, 0.9), ("a", "v", 2, OFF, 0.7), ("b", "v", 1, OTH, 0.6),
        ("d", "v", 1, OTH, 0.6), ("d", "v", 1, OFF, 0.8),
    ], PORTIONS)
    rows = sorted((r["id"], r["label"], round(r["score"], 6)) for r in sc.combine_portions(df).collect())
    assert rows == [("a", OFF, 0.8), ("b", OTH, 0.6), ("d", OFF, 0.8), ("d", OTH, 0.6)]
    with pytest.raises(ValueError, match="more than one label"):
        sc.assert_one_label(sc.combine_portions(df))
    assert sc.assert_one_label(sc.combine_portions(df), rule="no_repeat").count() == 4


def test_scorers(spark):
    df = spark.createDataFrame([(1, "du bist dumm dumm"), (2, "sehr schön"), (3, "kaputt")], "id int, text string")
    lexicon = {r["id"]: r for r in sc.score_portions(df, sc.LexiconScorer(["dumm"]), "text").collect()}
    assert lexicon[1]["label"] == OFF and lexicon[2]["label"] == OTH and lexicon[2]["score"] == 1.0

    def predict(model, texts):
        if (texts == "kaputt").any():
            raise ValueError("no")
        return [(OFF if model in t else OTH, 0.9) for t in texts]

    rows = {r["id"]: r for r in sc.score_portions(df, sc.PandasScorer(lambda: "dumm", predict), "text").collect()}
    assert rows[1]["label"] == OFF and rows[2]["label"] == OTH
    assert rows[3]["label"] is None and rows[3]["error"] == "ValueError: no"


def test_trained_scorer_separates_its_training_data(spark):
    rows = [(i, ("böse wort " if i % 2 else "nettes lob ") * 5 + f"w{i % 7}", OFF if i % 2 else OTH) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    scored = sc.score_portions(df.drop("label"), sc.PipelineScorer.train(df), "text")
    hits = scored.withColumnRenamed("label", "p").join(df.select("id", "label"), "id").where("p = label").count()
    assert hits == 60
