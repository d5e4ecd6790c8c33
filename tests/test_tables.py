"""Joins, aggregates, reshaping and columns on tiny tables."""

import datetime as dt

import pytest

from forumgauge.operators import aggregates as agg
from forumgauge.operators import columns as col
from forumgauge.operators import joins
from forumgauge.operators import reshape
from forumgauge.operators import topk

OFF, OTH = "OFFENSE", "OTHER"


def test_cutoff_compares_like_with_like(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1, 0, 0)), (2, dt.datetime(2020, 1, 1, 8, 0)), (3, dt.datetime(2020, 1, 2))],
        "id int, published_at timestamp")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(col.cutoff_filter(df, "2020-01-01")) == [2, 3]
    assert ids(col.cutoff_filter(df, "2020-01-01", on="date")) == [3]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "a int, thumbnail_url int, b int, c string")
    out = col.project_columns(df, drop=["b"], drop_containing="thumbnail", rename={"c": "d"}, first=["d"])
    assert out.columns == ["d", "a"]
    likes = spark.createDataFrame([(3, 1), (0, 0)], "like_count int, dislike_count int")
    assert [r["like_ratio"] for r in col.like_ratio(likes).collect()] == [0.75, None]
    assert col.mean_like_ratio(likes).first()[0] == 0.75
    places = spark.createDataFrame([("v", 12.5, "wort"), ("v", 1.0, "da")], "vid string, start double, word string")
    assert col.term_occurrences(places, "wort").first()["link"] == "https://youtu.be/v?t=12"
    link = col.episode_links(spark.createDataFrame([("aB3-x_Yz12",)], "video_id string")).first()
    assert link["link_id"] == "aB3-x_Yz12"


def test_flags(spark):
    df = spark.createDataFrame([("bill gates",), ("guten tag",), (None,)], "bigram string")
    rows = col.flag_members(df, "bigram", ["bill gates"]).collect()
    assert [(r["bigram"], r["flagged"]) for r in rows] == [("**bill gates**", True), ("guten tag", False), (None, False)]


def test_anti_filter_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    keys = spark.createDataFrame([(1,), (None,)], "id int")
    assert sorted(r["id"] or 0 for r in joins.anti_filter(df, keys, "id").collect()) == [0, 2]
    assert [r["id"] for r in joins.semi_filter(df, keys, "id").collect()] == [1]


def test_score_join_drops_the_sample_row(spark):
    episodes = spark.createDataFrame([("v", 1), ("w", 2)], "video_id string, views int")
    scores = spark.createDataFrame([("c1", "v", OFF), ("12345", "v", OTH), ("c9", "x", OTH)], "id string, video_id string, label string")
    comments = spark.createDataFrame([("c1", "v", "hm"), ("c2", "w", "ja")], "id string, video_id string, text string")
    assert [tuple(r) for r in joins.score_join(episodes, scores, comments).select("id", "text", "views").collect()] == [("c1", "hm", 1)]


def test_copies_of_a_text_do_not_multiply(spark):
    copies = 2000
    annotated = spark.createDataFrame([("same", OFF)] * copies + [("only", OTH)], "text string, truth string")
    scored = spark.createDataFrame([("same", OFF, 0.9)] * copies + [("same", OTH, 0.6)], "text string, label string, score double")
    joined = joins.annotation_join(annotated, scored)
    assert joined.count() == 3
    assert joined.where("predicted is null").first()["text"] == "only"


def test_grid_is_zero_filled_for_null_authors_too(spark):
    df = spark.createDataFrame([("a", OTH), (None, OFF)], "author_id string, label string")
    grid = {(r["author_id"], r["label"]): r["n"] for r in joins.complete_grid(df, "author_id").collect()}
    assert grid == {("a", OFF): 0, ("a", OTH): 1, (None, OFF): 1, (None, OTH): 0}
    other = spark.createDataFrame([("a", OTH), ("b", "SPAM"), ("b", None)], "author_id string, label string")
    every = {(r["author_id"], r["label"]): r["n"] for r in joins.complete_grid(other, "author_id").collect()}
    assert every == {(a, l): int((a, l) in (("a", OTH), ("b", "SPAM"))) for a in "ab" for l in (OFF, OTH, "SPAM")}
    rest = {(r["author_id"], r["label"]): r["n"] for r in joins.complete_grid(other, "author_id", rest="REST").collect()}
    assert rest[("b", "REST")] == 1 and len(rest) == 6
    shares = {r["author_id"]: r["prop_offense"] for r in agg.author_toxic_share(df).collect()}
    assert shares == {"a": 0.0, None: 100.0}


def test_toxic_share_scopes(spark):
    rows = [("v", 1, OFF)] * 2 + [("v", 1, OTH)] * 2 + [("w", 2, OTH)] * 4 + [("w", 2, None)]
    df = spark.createDataFrame(rows, "video_id string, date int, label string")
    group = agg.toxic_share(df, 0.5).collect()
    assert [(r["video_id"], r["n"], round(r["prop_offense"], 4)) for r in group] == [("v", 1.0, 33.3333)]
    assert agg.toxic_share(df, 0.5, scope="global").first()["prop_offense"] == pytest.approx(100 / 8)
    assert agg.toxic_total(agg.toxic_share(df)).first()[0] == 2.0


def test_weeks_start_on_sunday(spark):
    days = [dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 13)]
    df = spark.createDataFrame([(d,) for d in days], "published_at date")
    weeks = {r["year_week"]: r["n"] for r in agg.weekly_frequency(df).collect()}
    assert weeks == {dt.date(2023, 12, 31): 1, dt.date(2024, 1, 7): 2}


def test_histogram_and_density(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    bins = agg.histogram(df, "x", bins=5).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [2, 2, 2, 2, 3]
    same = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert agg.histogram(same, "x").first()["n"] == 2
    grid = agg.density(df, "x", points=64, bandwidth=1.0).orderBy("at").collect()
    area = sum((a["density"] + b["density"]) / 2 * (b["at"] - a["at"]) for a, b in zip(grid, grid[1:]))
    assert 0.85 < area < 1.0


def test_term_document_counts_keep_unused_terms(spark):
    terms = spark.createDataFrame([("a",), ("z",)], "term string")
    tokens = spark.createDataFrame([("v", "a"), ("v", "a"), ("w", "a")], "vid string, word string")
    got = sorted((r["term"], r["vid"] or "", r["n"]) for r in agg.term_document_counts(terms, tokens).collect())
    assert got == [("a", "v", 2), ("a", "w", 1), ("z", "", 0)]
    assert agg.term_document_counts(terms, tokens, unused=1).where("term = 'z'").first()["n"] == 1


def test_quantile_lookup(spark):
    q = spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (0.8, 50.0), (0.9, 50.0), (1.0, 100.0)], "prob double, value double")
    assert tuple(agg.quantile_lookup(q).first()) == (50.0, 80.0, 100.0)


def test_reshaping(spark):
    long = spark.createDataFrame([("d", 1, 0.3), ("d", 2, 0.7), ("e", 1, 1.0)], "document string, topic int, gamma double")
    wide = reshape.pivot_wider(long, ["document"], "topic", "gamma", [1, 2], "t_")
    assert {tuple(r) for r in wide.collect()} == {("d", 0.3, 0.7), ("e", 1.0, None)}
    assert reshape.pivot_longer(wide, ["document"], ["t_1", "t_2"]).count() == 4
    names = spark.createDataFrame([("(Intercept)",), ("t_3",)], "term string")
    assert [r["topic"] for r in reshape.separate_column(names, "term", ["junk", "topic"], integers=["topic"]).collect()] == [None, 3]
    lists = spark.createDataFrame([(1, ["a"]), (2, [])], "id int, xs array<string>")
    assert reshape.unnest_lists(lists, "xs", "x").count() == 1
    assert reshape.unnest_lists(lists, "xs", "x", keep_empty=True).count() == 2
    terms = spark.createDataFrame([("a,  b",), ("b, c",)], "terms string")
    assert {r["term"]: r["n"] for r in reshape.shared_terms(terms).collect()} == {"a": 1, "b": 2, "c": 1}
    tagged = reshape.union_tagged({"x": terms, "y": names})
    assert tagged.columns == ["terms", "origin", "term"] and tagged.count() == 4


def test_bigrams(spark):
    df = spark.createDataFrame([(OFF, "Bill Gates und Bill Gates"), (OTH, "gut gut"), (OFF, "eins")], "label string, text string")
    top = topk.top_bigrams(df, ["und"]).collect()
    assert [(r["bigram"], r["n"], r["flagged"]) for r in top] == [("**bill gates**", 2, True)]


def test_listing_and_sorting(spark):
    df = spark.createDataFrame([(2, OFF), (1, OFF), (3, OTH)], "id int, label string")
    assert [r["id"] for r in topk.toxic_listing(df, ["id"], limit=1).collect()] == [1]
    assert [r["id"] for r in topk.sort_by(df, "-id").collect()] == [3, 2, 1]


def test_link_id_may_hold_any_letter(spark):
    from forumgauge.operators import columns

    rows = columns.episode_links(spark.createDataFrame([("abvcd",), ("v=x",), (None,)], "video_id string")).collect()
    assert [r.link_id for r in rows] == ["abvcd", "v=x", None]


def test_coherence_survives_repeated_cells_and_absent_terms(spark):
    from forumgauge.operators import topics

    beta = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.4), (2, "y", 0.7), (2, "z", 0.3)], "topic int, term string, beta double")
    counts = spark.createDataFrame([("d", "a", 1), ("d", "a", 1)], "document string, term string, n int")
    found = {r.topic: r.semantic_coherence for r in topics.semantic_coherence(beta, counts).collect()}
    assert found == {1: 0.0, 2: None}


def test_top_rows_are_limited_before_the_shuffle_for_any_n(spark):
    from forumgauge.operators import windows

    df = spark.range(0, 5000, 1, 4).selectExpr("id % 2 AS k", "id AS x")
    assert windows.top_n_per_group(df, "x", 1001, ["k"]).count() == 2002
    plan = windows.top_n_per_group(df, "x", 1001, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__own") and "__part" in plan
