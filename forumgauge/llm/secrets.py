"""Secrets in texts, told apart by who owns them across the corpus.

Three kinds of span come from patterns. Their values, and long mixed strings without a
keyword as further candidates, are counted over the whole corpus by distinct repositories
and owners: a value that many owners have is a widely copied example, one that a single
owner has looks live. Further candidates that look live are added to the spans.

Everything is built-in expressions. A position is the sum of what lies before it: the
pieces between matches and the matches themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Further candidates: long strings that mix lower case, upper case and digits.
MIXED = "[A-Za-z0-9+/_-]{24,}"
VALUE = 12
#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3
_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, found: Column, values: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, stop, value) of the matches ``found`` of a pattern."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    lengths = F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.arrays_zip(found.alias("m"), values.alias("v")),
        lambda gap, x: F.struct(gap.alias("gap"), F.length(x.m).alias("size"), x.v.alias("v")),
    )
    walked = F.aggregate(
        lengths, start,
        lambda s, x: F.struct(
            (s.at + x.gap + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNull(), s.out).otherwise(F.concat(s.out, F.array(F.struct(
                (s.at + x.gap).alias("start"), F.lit(kind).alias("kind"), (s.at + x.gap + x["size"]).alias("stop"), x.v.alias("value"),
            )))).cast(_SPANS).alias("out"),
        ),
    ).out
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(_SPANS))


def candidates(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """``row, id, repository, owner, base, further``: the spans of every row; texts are left behind."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = source.withColumns({
        "assign": F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)), "access": F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        "hex": F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), "mixed": F.regexp_extract_all("text", F.lit(MIXED), F.lit(0)),
    })
    text = F.col("text")
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    spans = found.select(
        "row", "id", "repository", "owner",
        F.filter(_spans(text, F.col("assign"), values, ASSIGN, 0), lambda s: F.length(s.value) >= VALUE).alias("assign"),
        _spans(text, F.col("access"), F.col("access"), ACCESS, 1).alias("access"), _spans(text, F.col("hex"), F.col("hex"), HEX, 2).alias("hex"),
        F.filter(
            _spans(text, F.col("mixed"), F.col("mixed"), MIXED, 3),
            lambda s: s.value.rlike("[a-z]") & s.value.rlike("[A-Z]") & s.value.rlike("[0-9]"),
        ).alias("mixed"),
    )
    base = spans.select("row", "id", "repository", "owner", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "mixed")
    apart = F.filter("mixed", lambda s: ~F.exists("base", lambda b: (b.start < s.stop) & (s.start < b.stop)))
    return base.select("row", "id", "repository", "owner", "base", apart.alias("further"))


def owners(spans: DataFrame) -> DataFrame:
    """``value, repositories, owners``: in how many of each a value occurs; null counts as one of its own."""
    each = spans.groupBy("value", "repository", "owner").agg(F.count("*").alias("n"))
    repositories = each.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    persons = each.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    return repositories.join(persons, "value")


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None,
) -> DataFrame:
    """``id_col, spans, n_live, n_examples`` of every row of ``docs``.

    ``spans`` is an array of (start, kind, stop, value) in code points by start, then kind: 0 to 2 as
    in KINDS, 3 for an added live-looking value. ``n_live`` and ``n_examples`` count the row's
    spans whose value one owner has, or at least ``EXAMPLE_OWNERS`` have. Null and empty texts have
    no spans; repeated rows are kept and are one owner; null repositories and owners count as one
    each; other columns are not read; an empty table gives no rows.
    """
    unknown = F.lit(None).cast("string")
    rows = written(candidates(docs, id_col, text_col, unknown if repository is None else repository, unknown if owner is None else owner), "secrets")
    each = rows.select("row", "repository", "owner", F.inline(F.concat("base", "further")))
    known = each.withColumn("value", F.sha2("value", 256))
    judged = known.join(owners(known), "value").groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == 3) & (F.col("owners") == 1), F.col("start"))).alias("added"),
        F.count(F.when((F.col("owners") == 1), 1)).alias("n_live"),
        F.count(F.when((F.col("owners") >= EXAMPLE_OWNERS), 1)).alias("n_examples"),
    )
    out = rows.join(judged, "row", "left")
    live = F.filter("further", lambda s: F.array_contains(F.coalesce("added", F.array().cast("array<int>")), s.start))
    return out.select(
        F.col("id").alias(id_col), F.array_sort(F.concat("base", live)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
    )


def listed(spans: Column, names: tuple[str, ...] = (*KINDS, "live")) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.stop.cast("string"))))
