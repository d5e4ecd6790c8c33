"""Suffix arrays by grouping and removal of repeated bytes, against plain versions."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumgauge.llm import suffixarray

SCHEMA = "doc_id long, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffixes_are_in_order(symbols):
    symbols = [*symbols, 0]
    assert suffixarray.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 200, "abaab" * 80, "", "banana", "mississippi" * 9, "abcabcabdabcabcabe" * 7])
def test_periodic_texts(text):
    symbols = [*text.encode(), 0]
    assert suffixarray.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def plain(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for (i, _), r in zip(rows, raw):
        gone = {p for k in range(len(r) - size + 1) if count[r[k : k + size]] > 1 for p in range(k, k + size)}
        runs = sum(1 for p in gone if p - 1 not in gone)
        out.append((i, len(r), len(gone), runs, bytes(b for p, b in enumerate(r) if p not in gone)))
    return sorted(out, key=str)


def removed(df, **options):
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixarray.without_repeated_bytes(df, **options).collect()), key=str)


@pytest.mark.parametrize("classes, step", [(256, 1 << 21), (2, 50), (1, 1 << 21)])
def test_small_windows(spark, monkeypatch, classes, step):
    """Random texts of few letters, so that many windows repeat, overlap, and share grams."""
    monkeypatch.setattr(suffixarray, "CLASSES", classes)
    monkeypatch.setattr(suffixarray, "STEP", step)
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ab c"), rng.integers(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 90), (103, "xyz" * 30), (104, rows[3][1]), (104, rows[3][1]), (None, rows[5][1]), (None, "éü日本" * 9), (105, "éü日本" * 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("id", "print", "key", "n", "first", "spans")})
    assert removed(df, size=12, gram=4) == plain(rows, 12)


def test_whole_windows(spark):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh ijklmé"), n))
    passage, other = text(900), text(420)
    rows = [(i, text(500) + passage + text(300)) for i in range(4)] + [(9, text(50) + passage[:399] + "!" + passage[400:790]), (10, other), (11, "z" + other)]
    rows += [(12, "w" * 30_000), (13, " ".join(f"long{i}" for i in range(60_000))), (14, passage[100:499]), (15, text(2000))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert removed(df) == plain(rows, 400)
    assert suffixarray.without_repeated_bytes(df.limit(0)).count() == 0


def test_one_passage_in_very_many_texts(spark, monkeypatch):
    """A key with more classes than a task takes is split until it fits; windows that repeat are still found."""
    monkeypatch.setattr(suffixarray, "CLASSES", 8)
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcdefgh ijklm"), n))
    common = text(300)
    heads = [text(90) for _ in range(12)]
    rows = [(i, heads[i % 12] + common + text(150) if i % 2 else text(120) + common + heads[i % 12]) for i in range(150)]
    rows += [(200 + i, text(120) + common + text(150)) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = removed(df, size=380)
    assert found == plain(rows, 380) and any(r[2] for r in found) and not all(r[2] for r in found)
