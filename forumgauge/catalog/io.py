"""Queries for sources and sinks: given tables are written to the shared folder in the
formats in question and read back."""

from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..operators.scoring import PipelineScorer
from ..session import scratch_path
from .. import sources as src
from . import query

CSV_OUT = {
    "header": "true", "escape": '"', "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


@query("read_csv_dir", "SELECT DISTINCT doc_id AS id, source AS video_id, md5(text) AS text_md5, n_chars AS like_count FROM documents")
def _(t):
    path = scratch_path(t.spark, "comments")
    files = t.raw("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("video_id"), "text",
        F.col("n_chars").alias("like_count"), F.lit("token").alias("nextPageToken"),
    )
    for _ in range(2):  # every file twice, as overlapping pages would bring
        files.write.mode("append").options(**CSV_OUT).csv(path)
    read = src.read_csv_dir(t.spark, path, files.schema)
    return read.select(
        F.col("id").cast("bigint").alias("id"), "video_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "like_count"
    )


@query("read_scores_typed", """
SELECT CAST(p.id AS VARCHAR) AS id, p.video_id, p.group_no, label, round(score, 6) AS score, md5(comments_reportion) AS portion_md5
FROM portion_scores s JOIN portions p ON s.id = p.id AND s.group_no = p.group_no""", "portion_scores portions")
def _(t):
    path = scratch_path(t.spark, "scores")
    columns = [F.col(c).cast("string") for c in ("label", "score")]
    scored = t.portion_scores.select("id", "group_no", "label", "score").join(t.portions, ["id", "group_no"])
    scored.select(*columns, "comments_reportion", F.col("id").cast("string"), "video_id", "group_no").write.options(**CSV_OUT).csv(path)
    read = src.read_scores_typed(t.spark, path)
    read = read.withColumn("portion_md5", F.md5(F.col("comments_reportion").cast("binary")))
    return rounded(read.drop("comments_reportion"), "score")


@query("read_table", """
SELECT 'parquet' AS format, doc_id AS id, source AS kind, md5(text) AS text_md5 FROM documents
UNION ALL SELECT 'csv', conv_id, role, md5(text) FROM conversations""")
def _(t):
    path = scratch_path(t.spark, "prepared")
    t.raw("conversations").select("conv_id", "role", "text").write.options(**CSV_OUT).csv(path)
    schema = t.raw("conversations").select("conv_id", "role", "text").schema
    csv = src.read_table(t.spark, path, schema, multiline=True).select(F.lit("csv").alias("format"), F.col("conv_id").alias("id"), F.col("role").alias("kind"), "text")
    parquet = src.read_table(t.spark, f"{t.folder}/documents.parquet").select(
        F.lit("parquet").alias("format"), F.col("doc_id").alias("id"), F.col("source").alias("kind"), "text")
    return parquet.unionByName(csv).select("format", "id", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("read_gold_tsv", """
SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS tweet_no, md5(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')) AS tweet_md5,
       lang AS coarse, source AS fine FROM documents""")
def _(t):
    path = scratch_path(t.spark, "gold")
    line = F.concat_ws("\t", F.regexp_replace("text", r"[\t\n\r]", " "), "lang", "source")
    t.raw("documents").orderBy("doc_id").select(line.alias("value")).write.text(path)
    read = src.read_gold_tsv(t.spark, path)
    return read.select("tweet_no", F.md5(F.col("tweet").cast("binary")).alias("tweet_md5"), "coarse", "fine")


@query("write_table", "SELECT id, label, video_id, round(score, 6) AS score FROM scores", "scores")
def _(t):
    written = src.write_table(t.scores, scratch_path(t.spark, "table"), ["label"])
    return rounded(written.select("id", "label", "video_id", "score"), "score")


@query("split_results_errors", """
SELECT CASE WHEN label IS NULL THEN 'errors' ELSE 'results' END AS outcome, c.id, label, CASE WHEN label IS NULL THEN 'no label' END AS error
FROM comments c LEFT JOIN scores s ON c.id = s.id""", "comments scores")
def _(t):
    step = t.comments.select("id").join(t.scores.select("id", "label"), "id", "left")
    step = step.withColumn("error", F.when(F.col("label").isNull(), "no label"))
    results, errors = src.split_results_errors(step, scratch_path(t.spark, "outcome"))
    results = results.withColumns({"outcome": F.lit("results"), "error": F.lit(None).cast("string")})
    return results.unionByName(errors.withColumn("outcome", F.lit("errors")))


@query("save_load_model", "SELECT doc_id AS id, true AS unchanged FROM documents")
def _(t):
    texts = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    scorer = PipelineScorer.train(t.scores.select("id", "label").join(texts, "id"))
    path = src.save_model(scorer.model, scratch_path(t.spark, "model"))
    loaded = PipelineScorer(src.load_model(path))
    before = scorer.score(texts, "text").select("id", F.col("label").alias("l"), F.col("score").alias("s"))
    after = loaded.score(texts, "text").select("id", "label", "score")
    return after.join(before, "id").select("id", ((F.col("label") == F.col("l")) & (F.col("score") == F.col("s"))).alias("unchanged"))


@query("drop_nested_columns", "SELECT event_id, user_id FROM events")
def _(t):
    nested = t.raw("events").select(
        "event_id", "user_id", F.split("props", ",").alias("parts"), F.struct("value", "event_type").alias("details"),
        F.create_map("event_type", "value").alias("by_type"),
    )
    return src.drop_nested_columns(nested)


@query("flatten_records", """
SELECT conv_id, role, len(text) AS n_chars, unnest(string_split(text, '. ')) AS sentence FROM conversations""")
def _(t):
    meta = F.struct("role", F.length("text").cast("bigint").alias("n_chars"), F.split("text", r"\. ").alias("sentence"))
    return src.flatten_records(t.raw("conversations").select("conv_id", meta.alias("meta")), "meta", ["sentence"])


@query("normalize_names", "SELECT o_orderkey AS order_key, o_orderstatus AS statistics_order_status, o_totalprice AS total_price FROM orders")
def _(t):
    orders = t.raw("orders").select(
        F.col("o_orderkey").alias("orderKey"), F.col("o_orderstatus").alias("statistics.orderStatus"),
        F.col("o_totalprice").alias("Total Price"),
    )
    return src.normalize_names(orders)
