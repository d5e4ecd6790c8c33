"""Text expressions. Everything is a built-in column expression, so cleaning,
tokenising and portioning run inside one scan without a shuffle or Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import EMOTICONS

WORD = r"[\p{L}\p{N}_]+(?:[.'’:][\p{L}\p{N}_]+)*"
# A blank between single capitals that has at least one more of them beside it.
SPACED_CAPITALS = (
    r"\s(?=[A-Z](?:\s|$))(?:(?<=(?:^|\s)[A-Z]\s)(?=[A-Z]\s[A-Z](?:\s|$))|(?<=(?:^|\s)[A-Z]\s[A-Z]\s))"
)
HANDLE = r"@[A-Za-z0-9_]+"
URL = r"(?:http|www\.)\S*"
TAG = r"<[^>]+>"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DOTS = r"[.]{3,}"
# The same as \s+ -> one blank, but leaves single blanks alone.
WHITESPACE = r"\s{2,}|[^\S ]"
EMOTICON = "|".join(re.escape(e) for e in EMOTICONS)
# The same, tried only where an emoticon can start.
EMOTICON_SEARCH = "(?=[" + re.escape("".join(sorted({e[0] for e in EMOTICONS}))) + "])(?:" + EMOTICON + ")"
# Code points above 100000 (decimal); symbols below that survive.
NO_BREAK_SPACE = "\u00a0"
EMOJI = r"[\x{186A1}-\x{10FFFF}]"


def _drop(pattern: str, by: str = "", marks: tuple[str, ...] = ()):
    """Replace a pattern; texts that hold none of the literal ``marks`` skip the search."""

    def step(c: Column) -> Column:
        replaced = F.regexp_replace(c, pattern, by)
        if not marks:
            return replaced
        possible = reduce(Column.__or__, [F.contains(c, F.lit(m)) for m in marks])
        return F.when(possible, replaced).otherwise(c)

    return step


def cleaning_steps(profile: str = "comment", emails_first: bool = False, spaced_capitals: bool = True):
    """The ordered ``(name, column -> column)`` list of cleaning.

    ``profile="tweet"`` also removes ``#`` and, last, whatever follows an ``@``.
    By default handles go before e-mail addresses, which leaves the tail of an
    address behind; ``emails_first`` swaps the two. A step refers to its column more
    than once, so give each step a column of its own (``operators.text`` does).
    """
    if profile not in ("comment", "tweet"):
        raise ValueError(f"unknown profile {profile!r}")
    steps = [
        ("handles", _drop(HANDLE, "", ("@",))),
        ("urls", _drop(URL, "", ("http", "www."))),
        ("html", _drop(TAG, " ", ("<",))),
        ("emails", _drop(EMAIL, "", ("@",))),
    ]
    if emails_first:
        steps = [steps[3], *steps[:3]]
    if spaced_capitals:
        steps.insert(0, ("spaced_capitals", _drop(SPACED_CAPITALS)))
    if profile == "tweet":
        steps.append(("hashes", lambda c: F.replace(c, F.lit("#"), F.lit(""))))
    steps += [
        ("whitespace", _drop(WHITESPACE, " ")),
        ("quadruple_quotes", lambda c: F.replace(c, F.lit('""""'), F.lit(""))),
        ("dots", _drop(DOTS, "", ("...",))),
        ("quotes", lambda c: F.replace(c, F.lit('"'), F.lit(""))),
        ("emoticons", _drop(EMOTICON_SEARCH)),
        ("emoji", _drop(EMOJI, NO_BREAK_SPACE)),
    ]
    if profile == "tweet":
        steps.append(("handle_tails", _drop(r"@\S+", "", ("@",))))
    return steps


def words(column: Column) -> Column:
    """Array of lower-case word tokens; dots and apostrophes inside a word stay."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Array of n-grams of a token array; fewer than ``n`` tokens give null.

    The array is joined with itself shifted, so the work is linear in its length. Pass
    a materialised column: the expression refers to it several times.
    """
    count = F.size(tokens) - (n - 1)
    grams = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, F.lit(shift + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) >= n, grams)


def split_tokens(column: Column) -> Column:
    """Tokens between single blanks; one trailing blank does not open a token."""
    return F.split(F.regexp_replace(column, r" \z", ""), " ")


def portions(tokens: Column, size: int) -> Column:
    """Array of texts with at most ``size`` tokens each. Pass a materialised column."""
    last = F.floor((F.size(tokens) - 1) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda g: F.array_join(F.slice(tokens, g * size + 1, size), " "),
    )


def squish(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def snake_case(name: str) -> str:
    """``videoId`` -> ``video_id``; any other character run becomes one underscore."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
