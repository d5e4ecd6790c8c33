"""Token alignment against a plain version that encodes whole texts."""

import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumgauge.llm import alignment
from forumgauge.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_ends_meet(a, b):
    a, b = sorted({*a, 61}), sorted({*b, 61})
    shared = sorted({*a} & {*b})
    assert alignment.meet(a, b) == ([a.index(x) + 1 for x in shared], [b.index(x) + 1 for x in shared])


def test_long_stretches_are_skipped():
    a = list(range(1, 100_001))
    b = [x for x in a if x not in (50_000, 70_000, 70_001)]
    reads = []

    class Counted(list):
        def __getitem__(self, at):
            reads.append(at)
            return list.__getitem__(self, at)

    upto = alignment.meet(Counted(a), b)
    assert len(upto[0]) == len(b) and upto[0][-1] == 100_000 and upto[1][-1] == len(b)
    assert len(reads) < 300


@pytest.mark.parametrize("listed", [1 << 14, 2, 0])
def test_pairs_of_groups(monkeypatch, listed):
    monkeypatch.setattr(alignment, "LISTED", listed)
    a, b = np.array([5, 5, 7, 1], np.int32), np.array([9, 2, 9, 9, 4], np.int32)
    pairs, times, ends = alignment.linked(a, b, np.array([3, 4]), np.array([3, 5]))
    found = [Counter(), Counter()]
    for at, (p, t) in enumerate(zip(pairs.tolist(), times.tolist())):
        found[int(at >= ends[0])][p >> 32, p & 0xFFFFFFFF] += t
    assert len(pairs) == ends[-1] and found == [{(5, 9): 4, (5, 2): 2, (7, 9): 2, (7, 2): 1}, {(1, 9): 1, (1, 4): 1}]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    letters = alignment.byte_letters()
    out, count = [], Counter()
    for i, text in rows:
        text, links, groups = text or "", Counter(), []
        e = one.encode(" " + text, add_special_tokens=False)
        a = [(t, bytes(letters[c] for c in one.id_to_token(t))) for t in e.ids]
        b = [(t, bytes([int(two.id_to_piece(t)[3:5], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode()) for t in two.encode(text)]
        if not text or any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
            out.append((i, [], [], [], links))
            continue
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        before = (0, 0)
        for high in sorted({*ends[0]} & {*ends[1]}):
            upto = tuple(bisect_right(es, high) for es in ends)
            own = [[t for t, _ in s[i:j]] for s, i, j in zip((a, b), before, upto)]
            groups.append(own)
            links.update((x, y) for x in own[0] for y in own[1])
            before = upto
        count.update(set(links))
        out.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    named = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return sorted((
        (i, len(a), len(b), len(g), sum(links.values()), named(g), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()))
        for i, a, b, g, links in out), key=str)


HARD = [
    None, "", " ", "a", "a  b\t\n c ", "  lead", "trail  ", "x▁y", "é\x00b", "<s> </s><|endoftext|> x<|endoftext|>", "日本語😀 한국어 العربية", "it's 12,345.67 don't", "x" * 3000,
    " " * 500, "a　b\xa0c d\x1c e", "\r\n\r\n-- ==\n", "Ünïcödé wörds aux éàê ﬁ ½", "á ‍", "1 2 3 4 5 6 7 8 9 10 " * 30,
]


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_scores(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "PAIRS", most)
    rows = list(enumerate(HARD)) + [(3, "a"), (3, "a"), (None, "it's here"), (90, " ".join(f"word{i % 877} x" for i in range(20_000)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("id", "row", "a", "b", "times", "count", "groups")})
    assert sorted(map(tuple, alignment.alignment_scores(df, *PATHS).collect()), key=str) == plain(rows)
    assert alignment.alignment_scores(df.limit(0), *PATHS).count() == 0


@pytest.mark.parametrize("units", [600_000, 50, 0])
def test_units_are_encoded_together(monkeypatch, units):
    monkeypatch.setattr(alignment, "UNITS", units)
    machine = alignment.Coders(*PATHS)
    sent = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    machine.a = Counted(machine.a)
    texts = [" ".join(f"w{i}x{k}" for i in range(100)) for k in range(20)]
    found = [(f[0], f[1], f[2], ";".join(f[3])) for f in machine.aligned(texts)]
    assert 0 < len(sent) <= 2000 / 32  # 2,000 different units
    rows = plain(list(enumerate(texts)))
    assert found == [(r[1], r[2], r[3], r[5]) for r in sorted(rows)]
    # a unit that does not come back is found among many, and takes no other with it; what is known is used again
    del sent[:]
    mixed = [*texts[:2], texts[2] + " x▁y", *HARD, texts[19]]
    rows = {r[0]: r for r in plain(list(enumerate(mixed)))}
    for again in range(2):
        for i, f in enumerate(machine.aligned([t or "" for t in mixed])):
            assert (rows[i][1:4], rows[i][5]) == ((f[0], f[1], f[2]), ";".join(f[3])) if f else rows[i][1:] == (0, 0, 0, 0, "", 0, 0)
    assert not machine.older.names or units < 600_000


def test_whole_table(spark, folder):
    from forumgauge.llm import queries

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = sorted(((*r[:5], r[6], r[7], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "") for r in plain([tuple(r) for r in docs.collect()])), key=str)
    assert sorted(map(tuple, queries.op13_alignment(spark, folder).collect()), key=str) == want
