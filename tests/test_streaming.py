from forumgauge.operators import scoring as sc
from forumgauge.operators import text as op
from forumgauge.session import scratch_path


def test_row_wise_operators_work_on_a_stream(spark, table):
    path = scratch_path(spark, "stream")
    pages = table("documents").select("doc_id", "text")
    pages.repartition(3).write.parquet(path)
    score = lambda df: sc.score_portions(
        op.portion_text(op.clean_text(df, output="text")), sc.LexiconScorer(["the"]))
    stream = score(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("scored_stream").exceptAll(score(pages)).count() == 0
    assert spark.table("scored_stream").count() == score(pages).count()
