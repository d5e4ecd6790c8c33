import pytest
from pyspark.sql import types as T

from forumgauge import sources as src
from forumgauge.functions.text import snake_case
from forumgauge.operators.scoring import PipelineScorer
from forumgauge.session import scratch_path, shared_dir, written

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("nextPageToken", T.StringType())])


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,nextPageToken\n1,"sagt ""ja""\nund geht",p1\n2,"",p1\n')
    (tmp_path / "b.csv").write_text('id,text,nextPageToken\n2,"",p2\n')
    df = src.read_csv_dir(spark, str(tmp_path), SCHEMA)
    assert df.columns == ["id", "text"]
    assert {r["id"]: r["text"] for r in df.collect()}["1"] == 'sagt "ja"\nund geht'
    assert df.count() == 2
    assert src.read_csv_dir(spark, str(tmp_path), SCHEMA, drop=(), key=["id"]).count() == 2


def test_gold_set_is_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "gold.txt"
    path.write_text("".join(f'tweet "{i}\tOTHER\tOTHER\n' for i in range(1, 5001)))
    rows = src.read_gold_tsv(spark, str(path)).collect()
    assert all(r["tweet"] == f'tweet "{r["tweet_no"]}' for r in rows) and len(rows) == 5000


def test_results_and_errors_are_split_in_one_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def step(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch.assign(error=[None if i % 2 else "bad" for i in batch["id"]])

    df = spark.range(100).mapInPandas(step, "id bigint, error string")
    results, errors = src.split_results_errors(df, scratch_path(spark, "split"))
    assert results.columns == ["id"] and results.count() == 50
    assert {r["error"] for r in errors.collect()} == {"bad"} and errors.count() == 50
    assert calls.value == 100


def test_nested(spark):
    df = spark.createDataFrame([(1, ("t", ["a", "b"])), (2, ("u", []))], "id int, meta struct<title: string, tags: array<string>>")
    flat = src.flatten_records(df, "meta", ["tags"])
    assert sorted((r["id"], r["title"], r["tags"] or "") for r in flat.collect()) == [(1, "t", "a"), (1, "t", "b"), (2, "u", "")]
    assert src.drop_nested_columns(df).columns == ["id"]


@pytest.mark.parametrize("raw, name", [
    ("videoId", "video_id"), ("contentDetails.videoId", "content_details_video_id"), ("pageInfo_totalResults", "page_info_total_results"),
    ("HTTPCode", "http_code"), ("Mean Score (%)", "mean_score"),
])
def test_names(spark, raw, name):
    assert snake_case(raw) == name


def test_repeated_names(spark):
    df = spark.createDataFrame([(1, 2)], "videoId int, `video.id` int")
    assert src.normalize_names(df).columns == ["video_id", "video_id_2"]


def test_models_survive_saving(spark):
    rows = [(i, "böse" if i % 2 else "lieb", "OFFENSE" if i % 2 else "OTHER") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    scorer = PipelineScorer.train(df)
    loaded = PipelineScorer(src.load_model(src.save_model(scorer.model, scratch_path(spark, "model"))))
    pick = lambda s: sorted((r["id"], r["label"], r["score"]) for r in s.score(df.drop("label"), "text").collect())
    assert pick(scorer) == pick(loaded)


class _Session:
    """Just enough of a session to ask for the shared folder."""

    def __init__(self, named, current, master):
        self.conf = self
        self.sparkContext = self
        self.named, self.current, self.master = named, current, master

    def get(self, key, default):
        return self.named or default

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_folder_is_the_one_the_session_names():
    session = _Session("hdfs:///shared", None, "yarn")
    assert shared_dir(session) == "hdfs:///shared" and session.current == "hdfs:///shared"
    assert shared_dir(_Session(None, "hdfs:///other", "yarn")) == "hdfs:///other"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(None, None, "yarn"))


def test_tables_are_written_to_the_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    table = written(spark.range(3))
    assert table.count() == 3
    assert table.inputFiles()[0].split(":")[-1].lstrip("/").startswith(shared_dir(spark).split(":")[-1].lstrip("/"))


def test_read_table_spreads_only_small_tables(spark, table, folder):
    few = src.read_table(spark, f"{folder}/pages.parquet", spread=True)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = src.write_table(table("pages").repartition(40), scratch_path(spark, "many"))
    assert src.read_table(spark, many.inputFiles()[0].rsplit("/", 1)[0], spread=True).count() == table("pages").count()
