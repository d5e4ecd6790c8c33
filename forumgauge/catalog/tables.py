"""The logical tables derived from the given raw tables, in Spark and as SQL.

Documents stand in for comments, their source for the episode, labels for scores,
conversations for subtitles, languages for topics.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..operators.aggregates import toxic_share
from ..operators.joins import score_join
from ..operators.terms import doc_term_counts
from ..operators.text import portion_text, tokenize_words
from ..operators.topics import heldout_split
from ..session import written
from ..sources import read_table

LANGUAGES = ("de", "en", "es", "fr")  # topic 1, 2, 3, 4
WORD_SQL = WORD.replace("'", "''")


class Tables:
    """Lazy access to raw tables (``raw``) and to the logical ones (properties)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", spread=True)

    @cached_property
    def episodes(self) -> DataFrame:
        no = F.substring("source", 4, 10).cast("int")
        return (
            self.raw("documents").groupBy("source")
            .agg(
                F.count("*").alias("comment_count"),
                F.sum("n_chars").alias("view_count"),
                F.count_if(F.col("n_chars") % 3 == 0).alias("like_count"),
                F.count_if(F.col("n_chars") % 7 == 0).alias("dislike_count"),
            )
            .select(
                F.col("source").alias("video_id"),
                no.alias("episode_no"),
                F.date_add(F.lit("2024-01-01").cast("date"), no).alias("date"),
                F.concat(F.when(no % 3 == 0, "Special ").otherwise("Daily "), F.col("source")).alias("title"),
                "comment_count", "view_count", "like_count", "dislike_count",
            )
        )

    @cached_property
    def comments(self) -> DataFrame:
        author = F.concat(F.lit("u"), (F.col("doc_id") * 7919 % 97).cast("string"))
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.col("source").alias("video_id"), author.alias("author_id"),
            (F.col("n_chars") % 50).alias("like_count"), "text", "lang",
        )

    @cached_property
    def scores(self) -> DataFrame:
        documents = self.raw("documents").select("doc_id", F.col("source").alias("video_id"))
        return self.raw("labels").join(documents, "doc_id").select(
            F.col("doc_id").alias("id"), "video_id",
            F.when(F.col("toxic") == 1, "OFFENSE").otherwise("OTHER").alias("label"),
            (F.lit(0.5) + (F.col("doc_id") * 37 % 50) / 100).alias("score"),
        )

    @cached_property
    def annotated(self) -> DataFrame:
        return self.raw("labels").select(
            F.col("doc_id").alias("id"),
            F.when(F.col("quality") == 0, "OFFENSE").otherwise("OTHER").alias("truth"),
            F.when(F.col("toxic") == 1, "OFFENSE").otherwise("OTHER").alias("predicted"),
            (F.lit(0.5) + (F.col("doc_id") * 37 % 50) / 100).alias("score"),
        )

    @cached_property
    def author_comments(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("author_id"), F.to_date("ts").alias("video_id"),
            F.when(F.col("event_type") == "error", "OFFENSE").otherwise("OTHER").alias("label"),
        )

    @cached_property
    def subtitles(self) -> DataFrame:
        return self.texts("conversations").select(
            F.col("conv_id").alias("vid"), F.col("turn").alias("segment_id"),
            (F.col("turn") * F.lit(12.5)).alias("start"), "text",
        )

    @cached_property
    def subtitle_words(self) -> DataFrame:
        return tokenize_words(self.subtitles)

    @cached_property
    def scored(self) -> DataFrame:
        return score_join(self.episodes.select("video_id", "date"), self.scores, self.comments)

    @cached_property
    def shares(self) -> DataFrame:
        return toxic_share(self.scored)

    @cached_property
    def portions(self) -> DataFrame:
        comments = self.texts("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("video_id"), "text")
        return portion_text(comments)

    @cached_property
    def portion_scores(self) -> DataFrame:
        length = F.length("comments_reportion")
        return self.portions.select(
            "id", "video_id", "group_no",
            F.when(length % 3 == 0, "OFFENSE").otherwise("OTHER").alias("label"),
            (F.lit(0.5) + (length % 50) / 100).alias("score"),
        )

    @cached_property
    def fine_pairs(self) -> DataFrame:
        """Gold and predicted fine-grained labels."""
        fine = lambda c: F.when(c % 4 == 0, "ABUSE").when(c % 4 == 1, "INSULT").when(c % 4 == 2, "PROFANITY")
        return self.raw("labels").select(
            F.col("doc_id").alias("id"),
            F.when(F.col("quality") == 0, fine(F.col("doc_id"))).otherwise("OTHER").alias("truth"),
            F.when(F.col("toxic") == 1, fine(F.floor(F.col("doc_id") / 2))).otherwise("OTHER").alias("predicted"),
        ).na.fill("OTHER", ["truth", "predicted"])

    @cached_property
    def term_counts(self) -> DataFrame:
        """Terms per source and language, from which both topics and documents are summed."""
        texts = self.texts("documents").select("source", "lang", "text")
        counts = tokenize_words(texts, output="term").groupBy("source", "lang", "term").agg(F.count("*").alias("n"))
        return written(counts, "term-counts")

    @cached_property
    def beta(self) -> DataFrame:
        """Topic = language, beta = share of the term among the language's words."""
        counts = self.term_counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        totals = self.term_counts.groupBy("lang").agg(F.sum("n").alias("total"))
        topic = F.array_position(F.array(*[F.lit(v) for v in LANGUAGES]), F.col("lang")).cast("int")
        beta = counts.join(totals, "lang").select(topic.alias("topic"), "term", (F.col("n") / F.col("total")).alias("beta"))
        return written(beta, "beta")

    @cached_property
    def training_beta(self) -> DataFrame:
        """The same topics from the training cells of the sources alone, with all their terms."""
        cells = self.term_counts.withColumn("document", F.col("source"))
        training, _ = heldout_split(cells)
        counts = training.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        totals = training.groupBy("lang").agg(F.sum("n").alias("total"))
        topic = F.array_position(F.array(*[F.lit(v) for v in LANGUAGES]), F.col("lang")).cast("int")
        return counts.join(totals, "lang").select(topic.alias("topic"), "term", (F.col("n") / F.col("total")).alias("beta"))

    @cached_property
    def gamma(self) -> DataFrame:
        """Document = source, gamma = share of each language in its characters."""
        shares = self.raw("documents").groupBy("source").agg(
            F.sum("n_chars").alias("total"),
            *[F.sum(F.when(F.col("lang") == v, F.col("n_chars")).otherwise(0)).alias(v) for v in LANGUAGES],
        )
        cells = [
            F.struct(F.lit(i).alias("topic"), (F.col(v) / F.col("total")).alias("gamma"))
            for i, v in enumerate(LANGUAGES, start=1)
        ]
        return shares.select(F.col("source").alias("document"), F.inline(F.array(*cells)))

    @cached_property
    def source_terms(self) -> DataFrame:
        """Document-term table with the source as document."""
        return self.term_counts.groupBy(F.col("source").alias("document"), "term").agg(F.sum("n").alias("n"))

    @cached_property
    def document_counts(self) -> DataFrame:
        """Document-term table of single documents, for a plan that reads it once and may drop terms before they are counted."""
        words = tokenize_words(self.texts("documents").select(F.col("doc_id").alias("document"), "text"), output="term")
        return doc_term_counts(words)

    @cached_property
    def document_terms(self) -> DataFrame:
        """The same table, written."""
        return written(self.document_counts, "document-terms")

    @cached_property
    def subtitle_terms(self) -> DataFrame:
        """Document-term table of the subtitles."""
        return doc_term_counts(self.subtitle_words.withColumnsRenamed({"vid": "document", "word": "term"}))


CTES: dict[str, tuple[str, str]] = {
    "episodes": ("", """
        SELECT source AS video_id, CAST(substr(source, 4) AS INT) AS episode_no,
               DATE '2024-01-01' + CAST(substr(source, 4) AS INT) AS date,
               CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'Special ' ELSE 'Daily ' END || source AS title,
               count(*) AS comment_count, CAST(sum(n_chars) AS BIGINT) AS view_count,
               count(CASE WHEN n_chars % 3 = 0 THEN 1 END) AS like_count,
               count(CASE WHEN n_chars % 7 = 0 THEN 1 END) AS dislike_count
        FROM documents GROUP BY source"""),
    "comments": ("", """
        SELECT doc_id AS id, source AS video_id, 'u' || CAST(doc_id * 7919 % 97 AS VARCHAR) AS author_id,
               n_chars % 50 AS like_count, text, lang FROM documents"""),
    "scores": ("", """
        SELECT l.doc_id AS id, d.source AS video_id, CASE WHEN l.toxic = 1 THEN 'OFFENSE' ELSE 'OTHER' END AS label,
               0.5::DOUBLE + (l.doc_id * 37 % 50) / 100::DOUBLE AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
    "annotated": ("", """
        SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'OFFENSE' ELSE 'OTHER' END AS truth,
               CASE WHEN toxic = 1 THEN 'OFFENSE' ELSE 'OTHER' END AS predicted,
               0.5::DOUBLE + (doc_id * 37 % 50) / 100::DOUBLE AS score FROM labels"""),
    "author_comments": ("", """
        SELECT event_id AS id, user_id AS author_id, CAST(ts AS DATE) AS video_id,
               CASE WHEN event_type = 'error' THEN 'OFFENSE' ELSE 'OTHER' END AS label FROM events"""),
    "subtitles": ("", """
        SELECT conv_id AS vid, turn AS segment_id, turn * 12.5::DOUBLE AS start, text FROM conversations"""),
    "subtitle_words": ("subtitles", f"""
        SELECT vid, segment_id, start, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM subtitles"""),
    "scored": ("episodes comments scores", """
        SELECT s.id, s.video_id, s.label, s.score, c.author_id, c.like_count, c.text, c.lang, e.date
        FROM episodes e LEFT JOIN scores s ON e.video_id = s.video_id
        LEFT JOIN comments c ON s.id = c.id AND e.video_id = c.video_id
        WHERE CAST(s.id AS VARCHAR) <> '12345'"""),
    "shares": ("scored", """
        SELECT video_id, date, 'OFFENSE' AS label, CAST(count(*) FILTER (label = 'OFFENSE') AS DOUBLE) AS n,
               count(*) FILTER (label = 'OFFENSE') * 100.0::DOUBLE / count(*) AS prop_offense
        FROM scored GROUP BY video_id, date HAVING count(*) FILTER (label = 'OFFENSE') > 0"""),
    "portion_tokens": ("", r"""
        SELECT id, video_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS i
        FROM (SELECT doc_id AS id, source AS video_id, string_split(regexp_replace(text, ' \z', ''), ' ') AS tk
              FROM documents WHERE text <> '')"""),
    "portions": ("portion_tokens", """
        SELECT id, video_id, CAST((i - 1) // 300 + 1 AS INT) AS group_no, string_agg(tok, ' ' ORDER BY i) AS comments_reportion
        FROM portion_tokens GROUP BY id, video_id, (i - 1) // 300 + 1"""),
    "portion_scores": ("portions", """
        SELECT id, video_id, group_no,
               CASE WHEN length(comments_reportion) % 3 = 0 THEN 'OFFENSE' ELSE 'OTHER' END AS label,
               0.5::DOUBLE + (length(comments_reportion) % 50) / 100::DOUBLE AS score FROM portions"""),
    "fine_pairs": ("", """
        SELECT doc_id AS id,
               CASE WHEN quality = 0 THEN ['ABUSE', 'INSULT', 'PROFANITY', 'OTHER'][doc_id % 4 + 1] ELSE 'OTHER' END AS truth,
               CASE WHEN toxic = 1 THEN ['ABUSE', 'INSULT', 'PROFANITY', 'OTHER'][(doc_id // 2) % 4 + 1] ELSE 'OTHER' END AS predicted
        FROM labels"""),
    "language_terms": ("", f"""
        SELECT list_position(['de', 'en', 'es', 'fr'], lang) AS topic, term, count(*) AS n
        FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM documents)
        GROUP BY lang, term"""),
    "beta": ("language_terms", """
        SELECT topic, term, n / (sum(n) OVER (PARTITION BY topic))::DOUBLE AS beta FROM language_terms"""),
    "training_terms": ("", f"""
        SELECT list_position(['de', 'en', 'es', 'fr'], lang) AS topic, term, count(*) AS n
        FROM (SELECT source, lang, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM documents)
        WHERE ('0x' || substr(md5('42-' || source || '-' || term), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.25
        GROUP BY lang, term"""),
    "training_beta": ("training_terms", """
        SELECT topic, term, n / (sum(n) OVER (PARTITION BY topic))::DOUBLE AS beta FROM training_terms"""),
    "gamma": ("", """
        SELECT source AS document, topic,
               coalesce(sum(n_chars) FILTER (lang = ['de', 'en', 'es', 'fr'][topic]), 0)::DOUBLE / sum(n_chars)::DOUBLE AS gamma
        FROM documents, (SELECT unnest([1, 2, 3, 4]) AS topic) GROUP BY source, topic"""),
    "source_terms": ("", f"""
        SELECT document, term, count(*) AS n FROM (
          SELECT source AS document, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM documents)
        GROUP BY document, term"""),
    "document_terms": ("", f"""
        SELECT document, term, count(*) AS n FROM (
          SELECT doc_id AS document, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM documents)
        GROUP BY document, term"""),
    "subtitle_terms": ("subtitle_words", """
        SELECT vid AS document, word AS term, count(*) AS n FROM subtitle_words GROUP BY vid, word"""),
}


def with_ctes(names: list[str], body: str) -> str:
    """``body`` preceded by the named stand-in tables and whatever they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0].split():
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
