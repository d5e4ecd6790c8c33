from forumgauge.operators.scoring import LexiconScorer
from forumgauge.plans.comments import score_comments, toxicity_report
from forumgauge.plans.quality import annotation_reports, gold_reports, predict_gold
from forumgauge.session import scratch_path

OFF, OTH = "OFFENSE", "OTHER"


def test_from_comments_to_report(spark):
    long = " ".join(["wort"] * 300 + ["dumm"] * 10)
    comments = spark.createDataFrame(
        [("a", "v", "du bist D U M M dumm!"), ("b", "v", "nett"), ("c", "w", long), ("d", "w", "")],
        "id string, video_id string, text string")
    scores = score_comments(comments, LexiconScorer(["dumm"]), scratch_path(spark, "scores"))
    rows = {r["id"]: r for r in scores.collect()}
    # "" has no portion; the two portions of c disagree and P(OFFENSE) is (0 + 10/11) / 2
    assert {k: r["label"] for k, r in rows.items()} == {"a": OFF, "b": OTH, "c": OTH}
    assert round(rows["c"]["score"], 6) == round((0 + 10 / 11) / 2, 6)
    episodes = spark.createDataFrame([("v", 1, "t", 9), ("w", 2, "u", 8)], "video_id string, date int, title string, view_count int")
    annotated = spark.createDataFrame([(OFF, OFF), (OTH, OFF)], "truth string, predicted string")
    report = toxicity_report(episodes, scores, comments, annotated).collect()
    assert [(r["video_id"], r["n"], round(r["prop_offense"], 2), r["rolling_mean"]) for r in report] == [("v", 0.5, 33.33, None)]


def test_gold_set(spark):
    gold = spark.createDataFrame([("dumm dumm @x", OFF, "INSULT", 1), ("gut", OTH, "OTHER", 2), ("@nur", OTH, "OTHER", 3)],
                                 "tweet string, coarse string, fine string, tweet_no bigint")
    pairs = predict_gold(gold, LexiconScorer(["dumm"]), scratch_path(spark, "gold"))
    assert {r["tweet_no"]: r["predicted"] for r in pairs.collect()} == {1: OFF, 2: OTH, 3: None}
    reports = gold_reports(pairs)
    assert reports["metrics"].first()["precision"] == 1.0
    assert reports["report"].where("category = 'OTHER'").first()["recall"] == 50.0


def test_annotations(spark):
    annotated = spark.createDataFrame([("x", OFF), ("y", OTH), ("z", OFF)], "text string, truth string")
    scored = spark.createDataFrame([("x", OFF, .9), ("y", OFF, .6), ("z", OTH, .7)], "text string, label string, score double")
    reports = annotation_reports(annotated, scored, replicates=3)
    assert reports["correction"].first()["factor"] == 1.0 and reports["resampled"].count() == 3
