"""How far the sources of a language diverge in their words, by cubes of groups, groups and terms.

Every source of a language is compared with every other one, term by term. The work is a cube
of (group, group, term), and a task owns one cell of it: two blocks of groups and one block of
terms. A group's figures are replicated to the cells that need them, a cell adds up the part of
each divergence that its terms make, and the parts are summed along the term axis. A cell's size is
bounded by the sizes of blocks, whatever the number of sources or terms.

Counts that are zero are not stored. A cell knows how many terms its block holds, so the terms
that neither block of groups has are counted, not listed.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, slices, written

#: Documents of the language that must hold a term.
DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
#: Groups and terms of a block; a cell has at most about two blocks of groups times one of terms.
GROUPS = 64
TERMS = 4096
#: Entries a task counts before it hands them on.
ENTRIES = 400_000
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, df``: occurrences, and documents that hold the term; a null term for each group.

    A task counts within itself first, so what is shuffled is one row for each task, group and term.
    """

    def rows(found: dict) -> pa.RecordBatch:
        lang, source, term, n, df = [], [], [], [], []
        for (own_lang, own_source), (every, held) in found.items():
            lang += [own_lang] * (len(every) + 1)
            source += [own_source] * (len(every) + 1)
            term += [None, *(t.decode("utf-8") for t in every)]
            n += [0, *every.values()]
            df += [0, *(held[t] for t in every)]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())],
            ["lang", "source", "term", "n", "df"])

    def work(batches):
        found, size = defaultdict(lambda: (Counter(), Counter())), 0
        for part in slices(batches):
            for lang, source, text in zip(*(column_of(part, c).to_pylist() for c in ("lang", "source", "text"))):
                every, held = found[lang, source]
                before = len(every)
                own = Counter((text or "").encode().translate(_FOLDED).split())
                for t, k in own.items():
                    every[t] += k
                held.update(own.keys())
                size += len(every) - before
            if size > ENTRIES:
                yield rows(found)
                found.clear()
                size = 0
        if found:
            yield rows(found)

    named = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    parts = named.mapInArrow(work, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), by whole numbers that do not overflow; null without terms."""
    wide = "decimal(38,0)"
    top, bottom = (F.lit(SCALE).cast(wide) * (n + 2)).cast(wide), (total + 2 * terms).cast(wide)
    return F.call_function("div", top, F.when(terms > 0, bottom)) + 1


def apart(p, q):
    """floor((p - q)^2 / (p + q)), of columns or whole-number arrays."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def _cell(rows: pa.Table, members: pa.Table) -> pa.Table:
    """The divergences of all pairs of groups of a cell, as far as its terms make them."""
    names, empty, block = members["source"].to_pylist(), members["none"].to_numpy(), members["block"].to_numpy()
    low, high, lang = members["pair_low"][0].as_py(), members["pair_high"][0].as_py(), members["lang"][0].as_py()
    place = {name: i for i, name in enumerate(names)}
    coded = rows["term"].combine_chunks().dictionary_encode()
    terms = len(coded.dictionary)
    p = np.repeat(empty[:, None], terms, axis=1)
    p[[place[s] for s in rows["source"].to_pylist()], coded.indices.to_numpy()] = rows["p"].to_numpy()
    unseen = members["terms_here"][0].as_py() - terms
    first, second, value = [], [], []
    for i in np.flatnonzero(block == low):
        others = np.arange(i + 1, len(names)) if low == high else np.flatnonzero(block == high)
        first += [names[i]] * len(others)
        second += [names[j] for j in others]
        value += (apart(p[i], p[others]).sum(axis=1) + apart(empty[i], empty[others]) * unseen).tolist()
    return pa.table({
        "lang": pa.array([lang] * len(first), pa.string()), "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()),
        "part_value": pa.array(value, pa.int64())})


def pair_divergences(shares: DataFrame, groups: DataFrame, sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two sources ``a < b`` or ``b < a``, once, of a language.

    ``shares``: lang, source, term, p of counts above zero; ``groups``: lang, source, none (p of a count of zero);
    ``sizes``: lang, groups, terms; ``kept``: lang, term.
    """
    spread = lambda key, n: F.pmod(F.xxhash64(*key), n)
    blocks = sizes.select(
        "lang", F.greatest(F.ceil(F.col("groups") / GROUPS), F.lit(1)).alias("group_blocks"), F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).alias("term_blocks"))
    cell = ["lang", "pair_low", "pair_high", "term_block"]

    def replicated(df: DataFrame) -> DataFrame:
        """To the cells of the row's group block with every group block."""
        each = df.withColumn("block", spread(["source"], F.col("group_blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
        return each.withColumns({"pair_low": F.least("block", "other"), "pair_high": F.greatest("block", "other")})

    term_block = spread(["term"], F.col("term_blocks"))
    rows = replicated(shares.join(blocks, "lang").withColumn("term_block", term_block)).select(*cell, "source", "term", "p")
    held = kept.join(blocks, "lang").groupBy("lang", term_block.alias("term_block")).agg(F.count("*").alias("terms_here"))
    members = replicated(groups.join(blocks, "lang")).withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    members = members.join(held, ["lang", "term_block"], "left").select(
        *cell, "source", "block", F.coalesce("none", F.lit(1)).alias("none"), F.coalesce("terms_here", F.lit(0)).alias("terms_here"))
    parts = rows.groupBy(*cell).cogroup(members.groupBy(*cell)).applyInArrow(_cell, "lang string, a string, b string, part_value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("part_value").alias("value"))


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", documents: int = DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters (ASCII, of which only those are lower-cased, and all characters beyond ASCII). A language keeps
    terms that ``documents`` of its rows hold. Part ``pair`` has a row for each other source, all of them ranked; part
    ``term`` the ``top`` terms by which the source exceeds its language. Ranks count from 1, by value descending, then by the
    item's bytes. All numbers are whole and exact. Null text, lang and source count as empty ones, which are a
    language and a source like others. Repeated rows count as rows of their own. Groups without terms have pairs
    (of value 0 if the language keeps no term). Other columns are not read. An empty table gives no rows.
    """
    counts = written(term_counts(docs, lang_col, source_col, text_col), "terms")
    kept = written(
        counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= documents).select(
            "lang", "term", F.col("n").alias("lang_n")), "kept")
    known = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "counts")
    per_group = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    groups = counts.where("term IS NULL").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "lang_total", "terms"]).withColumn(
        "none", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.max("terms").alias("terms"))
    own = known.join(groups.drop("none"), ["lang", "source"]).withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = pair_divergences(own.select("lang", "source", "term", "p"), groups.select("lang", "source", "none"), sizes, kept.select("lang", "term"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    # a source's rows here are as many as the language's sources, and all of them are returned
    both = both.withColumn("rank", F.row_number().over(best))
    return both.unionByName(terms)
