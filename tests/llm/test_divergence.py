"""The divergence of sources against a plain version on whole numbers."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from forumgauge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, documents, top=10):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in df[lang].items() if n >= documents}
        own = {s: {t: count[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part in (pairs, terms):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i) for i, r in enumerate(ranked, 1) if r[0] == "pair" or i <= top]
    return sorted(out)


def rows():
    words = "alpha Beta gamma délta Ünï 日本 x end".split()
    out = []
    for i in range(160):
        text = " ".join(words[(i * k) % (3 + i % 6)] for k in range(i % 23)) + " !7a-b_c Z"
        out.append((i, text, ("en", "de", None, "")[i % 7 % 4], f"s{i * i % 11}" if i % 13 else None))
    out += [(1000, None, "fr", "a"), (1001, "", "fr", "b"), (1002, "1 2 3", "fr", None), (1003, "only one", "xx", "q"), (1, "a b c", "en", "s1"), (1, "a b c", "en", "s1")]
    return out + [(2000, "word " * 30000 + "alpha", "en", "long"), (None, "alpha", "en", "s1")]


@pytest.mark.parametrize("groups, terms, documents", [(64, 4096, 10), (2, 3, 2), (1, 1, 1)])
def test_divergence(spark, monkeypatch, groups, terms, documents):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit(0) for c in ("term", "n", "df", "p", "value", "block", "part")})
    found = divergence.source_divergence(df, documents=documents)
    assert sorted(map(tuple, found.collect())) == plain(rows(), documents)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_of_huge_counts(spark):
    n, total = 4 * 10**12, 5 * 10**13 + 1
    found = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).head().p
    assert found == 1 + 10**9 * (n + 2) // (total + 14)
