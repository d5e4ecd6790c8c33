import pytest
from pyspark.sql import functions as F

from forumgauge.functions import text as tx
from forumgauge.operators import text as op

NBSP = "\u00a0"


def clean(spark, value, **options):
    df = spark.createDataFrame([(value,)], "text string")
    return op.clean_text(df, **options).first()["text_display"]


@pytest.mark.parametrize("raw, expected", [
    ("a🤔b☺ü", f"a{NBSP}b☺ü"),
    ("das ist S U P E R gut A B c", "das ist SUPER gut A B c"),
    ("A B C", "ABC"),
    ("x@y.de", "x.de"),
    ("hallo @peter_1 da", "hallo da"),
    ("siehe https://a.b/c?d=e und www.x.ch jetzt", "siehe und jetzt"),
    ("<b>fett</b>&amp;", " fett &amp;"),
    ("a  b\n\tc", "a b c"),
    ("warte.... ja..", "warte ja.."),
    ('er sagte """"nein"""" "doch"', "er sagte nein doch"),
    ("gut :-) <3 ja ;-)", "gut   ja "),
])
def test_cleaning_of_comments(spark, raw, expected):
    assert clean(spark, raw) == expected


def test_profiles(spark):
    assert clean(spark, "#tag @ü.b x", profile="tweet") == "tag  x"
    assert clean(spark, "#tag", profile="comment") == "#tag"
    assert clean(spark, "x@y.de z", emails_first=True) == " z"
    assert clean(spark, None) is None
    with pytest.raises(ValueError):
        tx.cleaning_steps(profile="letter")


def test_removal_counts(spark):
    df = spark.createDataFrame([("a @b",), ("c  d",), ("e",)], "text string")
    counts = {r["step"]: r["n"] for r in op.removal_counts(df).collect()}
    assert counts["handles"] == 1 and counts["whitespace"] == 1 and counts["emoji"] == 0


@pytest.mark.parametrize("size, portions", [(299, 1), (300, 1), (301, 2), (600, 2), (601, 3)])
def test_portion_sizes(spark, size, portions):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(size)))], "id int, text string")
    rows = op.portion_text(df).orderBy("group_no").collect()
    assert [r["group_no"] for r in rows] == list(range(1, portions + 1))
    assert " ".join(r["comments_reportion"] for r in rows) == df.first()["text"]


def test_portions_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "a "), (3, " a"), (4, None), (5, "a  b")], "id int, text string")
    got = {(r["id"], r["comments_reportion"]) for r in op.portion_text(df).collect()}
    assert got == {(2, "a"), (3, " a"), (5, "a  b")}


def test_words(spark):
    df = spark.createDataFrame([(1, "Über www.youtube.com, x-y l'eau 3.5!")], "id int, text string")
    words = [r["word"] for r in op.tokenize_words(df).collect()]
    assert words == ["über", "www.youtube.com", "x", "y", "l'eau", "3.5"]
    left = op.remove_numbers(op.tokenize_words(df)).collect()
    assert "3.5" not in [r["word"] for r in left]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, "")], "id int, text string")
    got = sorted((r["id"], r["bigram"] or "") for r in op.tokenize_ngrams(df).collect())
    assert got == [(1, "a b"), (1, "b c"), (1, "c d"), (2, ""), (3, "")]
    three = [r["bigram"] for r in op.tokenize_ngrams(df.where("id = 1"), n=3).collect()]
    assert three == ["a b c", "b c d"]


def test_stopwords_by_list_and_table(spark):
    df = spark.createDataFrame([("der",), ("haus",), ("und",)], "word string")
    table = spark.createDataFrame([("der",), ("und",), ("und",)], "w string")
    for stop in (["der", "und"], table):
        assert [r["word"] for r in op.remove_stopwords(df, stop).collect()] == ["haus"]


def test_lemmas_and_patterns(spark):
    df = spark.createDataFrame([("häuser",), ("baum",)], "word string")
    lemmas = spark.createDataFrame([("häuser", "haus")], "word string, lemma string")
    assert sorted(r["word"] for r in op.lemmatize(df, lemmas).collect()) == ["baum", "haus"]
    terms = spark.createDataFrame([("vorlage",), ("or",), ("abc",)], "term string")
    assert [r["term"] for r in op.remove_terms_regex(terms, ["or"]).collect()] == ["abc"]
    assert [r["term"] for r in op.remove_terms_regex(terms, ["or"], anchored=True).collect()] == ["vorlage", "abc"]


def test_text_work_needs_no_shuffle(spark, table):
    pages = table("pages").select("page_id", F.col("html").alias("text"))
    plan = op.tokenize_words(op.portion_text(op.clean_text(pages, output="text")), "comments_reportion")
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical and "Python" not in physical


def test_tokens_are_computed_once_per_text(spark, table):
    for df in (op.tokenize_ngrams(table("documents")), op.portion_text(table("documents"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") + plan.count("split(") == 1
