"""Listings and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import BIGRAM_WATCHLIST, OFFENSE
from .aggregates import count_by
from .columns import flag_members
from .text import remove_stopwords, split_ngrams, tokenize_ngrams, unite_ngrams
from .windows import argmax_rows, top_n_per_group


def top_episodes(shares: DataFrame, episodes: DataFrame, n: int = 20, value: str = "prop_offense") -> DataFrame:
    """Episodes with the highest toxic share, ties kept, with their details."""
    top = top_n_per_group(shares, value, n)
    return top.join(episodes.drop("date"), "video_id", "left")


def worst_episode_comments(scored: DataFrame, shares: DataFrame, columns: Sequence[str], n: str = "n") -> DataFrame:
    """The toxic comments of the episode(s) with most toxic comments."""
    worst = argmax_rows(shares, n).select("video_id")
    toxic = scored.where(F.col("label") == OFFENSE)
    return toxic.join(worst, "video_id", "left_semi").select(*columns)


def toxic_listing(scored: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """All toxic comments; ``limit`` is for display only."""
    listing = scored.where(F.col("label") == OFFENSE).select(*columns)
    return listing.orderBy(*columns).limit(limit) if limit else listing


def toxic_bigrams(scored: DataFrame, stopwords: Sequence[str] | DataFrame, text: str = "text") -> DataFrame:
    """Bigrams of toxic comments with their number, without stop words.

    Counting comes before the stop-word test, so the test runs once per distinct
    bigram.
    """
    toxic = scored.where(F.col("label") == OFFENSE)
    counts = count_by(tokenize_ngrams(toxic, text, 2, keep=[]), "bigram").where(F.col("bigram").isNotNull())
    return unite_ngrams(remove_stopwords(split_ngrams(counts), stopwords, ("word1", "word2")))


def top_bigrams(
    scored: DataFrame,
    stopwords: Sequence[str] | DataFrame,
    n: int = 15,
    watchlist: Sequence[str] = BIGRAM_WATCHLIST,
    text: str = "text",
) -> DataFrame:
    """The most frequent bigrams of toxic comments, flagged against a watch list."""
    return flag_members(top_n_per_group(toxic_bigrams(scored, stopwords, text), "n", n), "bigram", watchlist)


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    """Order by columns, ``-name`` for descending; add a unique last column."""
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns])
