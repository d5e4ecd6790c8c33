"""Projection, filters and scalar columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATCH_URL = "https://www.youtube.com/watch?v="
SHORT_URL = "https://youtu.be/"


def project_columns(
    df: DataFrame,
    drop: Sequence[str] = (),
    drop_containing: str | None = None,
    rename: Mapping[str, str] | None = None,
    first: Sequence[str] = (),
) -> DataFrame:
    """Drop columns by name or name part, rename, and move some to the front."""
    kept = [c for c in df.columns if c not in drop and not (drop_containing and drop_containing in c)]
    renamed = [(c, (rename or {}).get(c, c)) for c in kept]
    ahead = [p for f in first for p in renamed if p[1] == f]
    return df.select(*[F.col(c).alias(n) for c, n in ahead + [p for p in renamed if p not in ahead]])


def filter_title(df: DataFrame, phrase: str, title: str = "title") -> DataFrame:
    return df.where(F.col(title).contains(phrase))


def cutoff_filter(df: DataFrame, after: str, column: str = "published_at", on: str = "timestamp") -> DataFrame:
    """Rows strictly after ``after``, compared as timestamps or as whole days.

    With ``on="timestamp"`` the cut-off day itself passes from its first instant
    onwards (exclusive); with ``on="date"`` the whole cut-off day is excluded.
    """
    if on == "timestamp":
        return df.where(F.col(column) > F.lit(after).cast("timestamp"))
    if on == "date":
        return df.where(F.to_date(column) > F.lit(after).cast("date"))
    raise ValueError(f"unknown comparison {on!r}")


def filter_label(df: DataFrame, value: str, label: str = "label", keep: bool = True) -> DataFrame:
    """Rows with (or, ``keep=False``, without) one value; null goes either way."""
    test = F.col(label) == value
    return df.where(test if keep else ~test)


def contains_term(df: DataFrame, term: str, text: str = "text") -> DataFrame:
    return df.where(F.col(text).contains(term))


def term_occurrences(tokens: DataFrame, term: str, vid: str = "vid", start: str = "start", word: str = "word"):
    """Each place a term is spoken, with a link to the full second."""
    second = F.regexp_replace(F.col(start).cast("string"), r"\.\d+", "")
    link = F.concat(F.lit(SHORT_URL), F.col(vid).cast("string"), F.lit("?t="), second)
    return tokens.where(F.col(word) == term).withColumn("link", link)


def episode_links(df: DataFrame, vid: str = "video_id") -> DataFrame:
    """A watch link from the id, and the id recovered from that link."""
    link = F.concat(F.lit(WATCH_URL), F.col(vid).cast("string"))
    return df.withColumn("link", link).withColumn("link_id", F.regexp_extract("link", r"[?&]v=([^&]*)", 1))


def calendar_parts(df: DataFrame, key: str, timestamp: str) -> DataFrame:
    """Distinct (key, date, year, month, year_month)."""
    day = F.to_date(timestamp)
    return df.select(
        key,
        day.alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.concat(F.year(day).cast("string"), F.month(day).cast("string")).alias("year_month"),
    ).distinct()


def like_ratio(df: DataFrame, likes: str = "like_count", dislikes: str = "dislike_count") -> DataFrame:
    """likes / (likes + dislikes); null where there is neither."""
    return df.withColumn("like_ratio", F.try_divide(F.col(likes), F.col(likes) + F.col(dislikes)))


def mean_like_ratio(df: DataFrame) -> DataFrame:
    return like_ratio(df).agg(F.avg("like_ratio").alias("mean_like_ratio"))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def flag_members(
    df: DataFrame, column: str, members: Sequence[str], flag: str = "flagged", mark: tuple[str, str] | None = ("**", "**")
) -> DataFrame:
    """Flag rows whose value is in a short list and wrap the value of those rows."""
    inside = F.coalesce(F.col(column).isin(list(members)), F.lit(False))
    df = df.withColumn(flag, inside)
    if mark:
        wrapped: Column = F.concat(F.lit(mark[0]), F.col(column), F.lit(mark[1]))
        df = df.withColumn(column, F.when(F.col(flag), wrapped).otherwise(F.col(column)))
    return df
