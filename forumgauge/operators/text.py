"""Corpus preparation: clean, portion, tokenise, drop, lemmatise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _staged(df: DataFrame, column: str, options: dict) -> tuple[DataFrame, list[str]]:
    """One column per cleaning step, ``__t0`` being the text itself."""
    steps = tx.cleaning_steps(**options)
    df = df.withColumn("__t0", F.col(column))
    for i, (_, step) in enumerate(steps, start=1):
        df = df.withColumn(f"__t{i}", step(F.col(f"__t{i - 1}")))
    return df, [name for name, _ in steps]


def clean_text(df: DataFrame, column: str = "text", output: str = "text_display", **options) -> DataFrame:
    """Add the cleaned text; see ``functions.text.cleaning_steps`` for the steps."""
    staged, names = _staged(df, column, options)
    cleaned = staged.withColumn(output, F.col(f"__t{len(names)}"))
    return cleaned.drop(*[f"__t{i}" for i in range(len(names) + 1)])


def removal_counts(df: DataFrame, column: str = "text", **options) -> DataFrame:
    """How many texts each cleaning step changes: ``(step_no, step, n)``, in one scan."""
    staged, names = _staged(df, column, options)
    changed = staged.agg(*[
        F.count_if(F.col(f"__t{i}") != F.col(f"__t{i - 1}")).alias(f"n{i}") for i in range(1, len(names) + 1)
    ])
    rows = [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i}").alias("n"))
        for i, name in enumerate(names, start=1)
    ]
    return changed.select(F.inline(F.array(*rows)))


def portion_text(df: DataFrame, column: str = "text", size: int = 300, output: str = "comments_reportion") -> DataFrame:
    """One row per portion of at most ``size`` tokens, numbered from 1; an empty text has
    none. No shuffle."""
    rest = [c for c in df.columns if c != column]
    # a condition on the text would be pushed below the steps that made it and repeat them all, so empty texts go last
    some = F.when(F.col(column) != "", tx.split_tokens(F.col(column)))
    cut = F.when(F.col("__tokens").isNotNull(), tx.portions(F.col("__tokens"), size))
    pieces = df.select(*rest, some.alias("__tokens")).select(*rest, F.posexplode_outer(cut).alias("__at", output))
    return pieces.where(F.col("__at").isNotNull()).select(*rest, (F.col("__at") + 1).alias("group_no"), output)


def tokenize_words(df: DataFrame, column: str = "text", output: str = "word", keep: Sequence[str] | None = None):
    """One row per word token. ``keep`` limits the other columns carried along."""
    rest = list(keep) if keep is not None else [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(tx.words(F.col(column))).alias(output))


def tokenize_ngrams(
    df: DataFrame, column: str = "text", n: int = 2, output: str = "bigram", keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per n-gram within a text; a shorter text gives one row with null."""
    rest = list(keep) if keep is not None else [c for c in df.columns if c != column]
    tokens = df.select(*rest, tx.words(F.col(column)).alias("__tokens"))
    return tokens.select(*rest, F.explode_outer(tx.ngrams(F.col("__tokens"), n)).alias(output))


def split_ngrams(df: DataFrame, column: str = "bigram") -> DataFrame:
    """Replace a bigram by its two words."""
    parts = F.split(column, " ")
    return df.withColumns({"word1": F.get(parts, 0), "word2": F.get(parts, 1)}).drop(column)


def unite_ngrams(df: DataFrame, column: str = "bigram") -> DataFrame:
    """The inverse of ``split_ngrams``."""
    return df.withColumn(column, F.concat_ws(" ", "word1", "word2")).drop("word1", "word2")


def remove_stopwords(
    df: DataFrame, stopwords: Sequence[str] | DataFrame, columns: Sequence[str] = ("word",)
) -> DataFrame:
    """Drop rows in which any of ``columns`` is a stop word.

    A list becomes a set test inside the scan. A table (first column) becomes an
    anti join; Spark broadcasts it when its size allows and otherwise shuffles,
    splitting hot words.
    """
    if not isinstance(stopwords, DataFrame):
        for c in columns:
            df = df.where(~F.col(c).isin(list(stopwords)))
        return df
    table = stopwords.select(F.col(stopwords.columns[0]).alias("__stop")).distinct()
    for c in columns:
        df = df.join(table, F.col(c) == F.col("__stop"), "left_anti")
    return df


def remove_numbers(df: DataFrame, column: str = "word") -> DataFrame:
    """Drop tokens that are numbers or empty."""
    return df.where(~F.col(column).rlike(r"^[\d.,]+$") & (F.col(column) != ""))


def lemmatize(df: DataFrame, dictionary: DataFrame, column: str = "word", count: str | None = None) -> DataFrame:
    """Replace each word by its lemma where the ``(word, lemma)`` dictionary has one.

    On large corpora pass counted words and name their ``count`` column: a frequent word then
    meets the dictionary once per group, and counts of words with the same lemma are added.
    """
    lemmas = dictionary.select(F.col("word").alias("__word"), F.col("lemma").alias("__lemma"))
    joined = df.join(lemmas, F.col(column) == F.col("__word"), "left")
    replaced = joined.withColumn(column, F.coalesce("__lemma", column)).drop("__word", "__lemma")
    if count is None:
        return replaced
    return replaced.groupBy(*[c for c in df.columns if c != count]).agg(F.sum(count).alias(count))


def remove_terms_regex(df: DataFrame, patterns: Sequence[str], column: str = "term", anchored: bool = False):
    """Drop terms matching any pattern, anywhere in the term unless ``anchored``."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return df.where(~F.col(column).rlike(f"^(?:{joined})$" if anchored else joined))


def explode_term_list(df: DataFrame, column: str = "terms", output: str = "term") -> DataFrame:
    """"a, b, c" -> one trimmed term per row."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.split(column, ",")).alias(output)).withColumn(output, tx.squish(F.col(output)))
