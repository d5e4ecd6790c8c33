"""Explicit schemas of the logical tables (nothing is inferred at read time)."""

from pyspark.sql import types as T

EPISODES = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("dislike_count", T.LongType()),
    T.StructField("comment_count", T.LongType()),
])

COMMENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("total_reply_count", T.LongType()),
])

SUBTITLES = T.StructType([
    T.StructField("vid", T.StringType()),
    T.StructField("segment_id", T.LongType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

PORTION_SCORES = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("comments_reportion", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("group_no", T.IntegerType()),
])

COMMENT_SCORES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

# Paging columns that the per-video comment files carry.
PAGING_COLUMNS = ("nextPageToken", "pageInfo_totalResults", "pageInfo_resultsPerPage")
