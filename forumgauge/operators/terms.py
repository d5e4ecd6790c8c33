"""Document-term tables. The sparse matrix is a long table ``(document, term, n)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordering
from ..functions import text as tx
from ..functions.keys import single
from ..functions.wordlists import OFFENSE
from ..session import written
from .text import lemmatize, tokenize_words
from .windows import top_n_per_group


#: Terms a vocabulary may have where it is needed in one place.
VOCABULARY = 2_000_000


def doc_term_counts(tokens: DataFrame, document: str = "document", term: str = "term") -> DataFrame:
    """Occurrences of each term per document; combined within tasks before the shuffle."""
    return tokens.groupBy(document, term).agg(F.count("*").alias("n"))


def trim_terms(
    counts: DataFrame, sparsity: float, document: str = "document", term: str = "term", documents: DataFrame | None = None,
) -> DataFrame:
    """Keep terms found in at least ``(1 - sparsity)`` of the documents.

    This also bounds the vocabulary: at most (mean distinct terms per document) /
    (1 - sparsity) terms can pass. ``documents`` is one row with the number of documents, if it is not that of ``counts``.
    """
    if documents is None:
        documents = counts.agg(F.count_distinct(document).alias("n"))
    frequent = _in_share(counts.groupBy(term).agg(F.count("*").alias("df")), sparsity, documents).select(term)
    return counts.join(frequent, term, "left_semi")


def _in_share(frequencies: DataFrame, sparsity: float, documents: DataFrame) -> DataFrame:
    return frequencies.where(F.col("df") >= F.lit(1 - sparsity) * single(documents))


def frequent_counts(
    texts: DataFrame, sparsity: float, chosen: Callable[[DataFrame], DataFrame], dictionary: DataFrame | None = None,
) -> DataFrame:
    """``(document, term, n)`` of texts ``(document, text)``: words that ``chosen`` keeps, of lemmas, trimmed as by ``trim_terms``.

    Words that can not pass are dropped before they are counted by document, so that what is shuffled and written is of the
    size of the trimmed table: a word is in at least as many texts as documents, and texts are counted without moving
    their words. The words left are counted and trimmed by documents as ever.
    """
    words = tokenize_words(texts, "text", output="term")
    once = texts.select("document", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term"))
    documents = written(chosen(once).agg(F.count_distinct("document").alias("n")), "documents")
    forms = chosen(once.groupBy("term").agg(F.count("*").alias("df"))).withColumn("word", F.col("term"))
    if dictionary is not None:
        forms = written(lemmatize(forms, dictionary, "term"), "forms")
        lemmas = _in_share(forms.groupBy("term").agg(F.sum("df").alias("df")), sparsity, documents)
        passing = forms.join(written(lemmas.select("term"), "lemmas"), "term", "left_semi")
    else:
        passing = _in_share(forms, sparsity, documents)
    # a written table, whose size tells Spark whether to drop the other words where they are read
    passing = written(passing.select(F.col("word").alias("term")).distinct(), "words")
    counts = doc_term_counts(words).join(passing, "term", "left_semi")
    if dictionary is not None:
        counts = lemmatize(counts, dictionary, "term", count="n")
    return trim_terms(written(counts.select("document", "term", "n"), "counts"), sparsity, documents=documents)


def vocabulary(counts: DataFrame, term: str = "term") -> DataFrame:
    """``(term, idx)``, indexed from 0 in alphabetical order."""
    numbered = ordering.position(counts.select(term).distinct(), [F.col(term).asc()], "idx")
    return numbered.withColumn("idx", (F.col("idx") - 1).cast("int"))


def to_sparse_vectors(counts: DataFrame, vocab: DataFrame, document: str = "document", term: str = "term"):
    """``(document, features)`` for Spark ML, built in the JVM from the repeated terms of a
    document. Documents without a term of the vocabulary have no row.

    The model needs the vocabulary in one place, so one of over ``VOCABULARY`` terms is
    refused: trim the terms first.
    """
    rows = vocab.select(term).orderBy("idx").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms: trim the terms")
    known = counts.join(vocab.select(term), term, "left_semi")
    if not rows:
        rows = [[""]]  # an empty vocabulary meets no documents
    repeated = F.flatten(F.collect_list(F.array_repeat(F.col(term), F.col("n").cast("int"))))
    words = known.groupBy(document).agg(repeated.alias("__terms"))
    model = CountVectorizerModel.from_vocabulary([r[0] for r in rows], inputCol="__terms", outputCol="features", minTF=1.0)
    return model.transform(words).select(document, "features")


def term_vectors(counts: DataFrame, vocab: DataFrame, document: str = "document", term: str = "term") -> DataFrame:
    """``(document, idx, n)``: places and counts of a document's terms, as arrays ordered by place. The vocabulary is joined,
    so it may have any size. Documents without a term of the vocabulary have no row."""
    cells = counts.join(vocab.select(F.col("term").alias(term), "idx"), term)
    listed = cells.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("n").cast("double").alias("n")))).alias("c"))
    return listed.select(F.col(document).alias("document"), F.col("c.idx").alias("idx"), F.col("c.n").alias("n"))


def from_sparse_vectors(vectors: DataFrame, vocab: DataFrame, document: str = "document") -> DataFrame:
    """Back to the long table. Only stored cells are unfolded."""
    stored = F.unwrap_udt("features")
    places = F.coalesce(stored["indices"], F.sequence(F.lit(0), F.size(stored["values"]) - 1))
    cells = F.explode(F.arrays_zip(places.alias("idx"), stored["values"].alias("n")))
    cells = vectors.select(document, cells.alias("c")).select(document, "c.idx", "c.n").where("n > 0")
    return cells.join(vocab, "idx").select(document, "term", F.col("n").cast("bigint").alias("n"))


def tf_idf(counts: DataFrame, document: str = "document", term: str = "term", top: int | None = 5) -> DataFrame:
    """tf * ln(N / df) per document and term; with ``top``, the best per document, ties kept.

    Documents are counted in the table given, so filter before, not after.
    """
    totals = counts.groupBy(document).agg(F.sum("n").alias("__doc"))
    frequencies = counts.groupBy(term).agg(F.count("*").alias("__df"))
    documents = single(totals.agg(F.count("*").alias("n")))
    weighted = counts.join(totals, document).join(frequencies, term)
    tf = F.col("n") / F.col("__doc")
    weighted = weighted.select(
        document, term, "n", tf.alias("tf"), F.ln(documents / F.col("__df")).alias("idf")
    ).withColumn("tf_idf", F.col("tf") * F.col("idf"))
    # finding the best and keeping them are two passes over the weighted table
    return top_n_per_group(written(weighted), "tf_idf", top, [document]) if top else weighted


def toxic_comment_words(scored: DataFrame, episodes: DataFrame, video: str = "video_id", text: str = "text") -> DataFrame:
    """Words of the distinct toxic texts of chosen episodes: ``(video, word)``."""
    toxic = scored.where(F.col("label") == OFFENSE).join(episodes.select(video), video, "left_semi")
    return tokenize_words(toxic.select(video, text).distinct(), text)
