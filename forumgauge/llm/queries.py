"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, divergence, lattice, lines, packing, quality, secrets, simhash, suffix, suffixarray, tokens, warc, winnow
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql.strip()
        return function

    return register


def tokenizer_path(name: str) -> str:
    """Where the package of public tokenizers keeps a file; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_lattice(spark, sf_dir):
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op3_token_counts(spark, sf_dir, model=None):
    return tokens.token_counts(table(spark, sf_dir, "documents"), model or tokenizer_path("piece_bpe_32k.model"))


def _duck_spans(column: str, pattern: str, kind: int, group: int = 0) -> str:
    """SQL for the spans of a pattern: a match starts behind the pieces and matches before it."""
    return f"""
    SELECT row, doc_id, source, lang, {kind} AS kind, start, start + length(m[i]) AS stop, v[i] AS value
    FROM (SELECT *, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) AS BIGINT)
                    + CAST(coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT *, regexp_extract_all({column}, '{pattern}', 0) AS m, regexp_extract_all({column}, '{pattern}', {group}) AS v,
                             regexp_split_to_array({column}, '{pattern}') AS p FROM d)))"""


_ASSIGN = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))").replace("'", "''")
_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id AS row, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_duck_spans("text", _ASSIGN, 0, 2)}) WHERE length(value) >= {secrets.VALUE}
         UNION ALL {_duck_spans("text", secrets.ACCESS, 1)} UNION ALL {_duck_spans("text", secrets.HEX, 2)}),
mixed AS (SELECT * FROM ({_duck_spans("text", secrets.MIXED, 3)})
          WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')),
further AS (SELECT * FROM mixed x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = x.row AND b.start < x.stop AND x.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM further),
known AS (SELECT value, count(DISTINCT source) AS owners FROM every GROUP BY value),
judged AS (SELECT e.*, owners FROM every e JOIN known USING (value)),
per AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {secrets.EXAMPLE_OWNERS}) AS n_examples,
               string_agg(concat((['assign', 'access', 'hex'])[kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) FILTER (kind < 3) AS b,
               string_agg(concat((['assign', 'access', 'hex', 'live'])[kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind)
                   FILTER (kind < 3 OR owners = 1) AS s FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN per USING (row)
"""


@query(_SECRETS_SQL)
def op4_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secrets.listed(F.filter("spans", lambda s: s.kind < 3)), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_examples",
    )


def packing_options() -> dict:
    import public_tokenizers

    return {
        "tokenizer": tokenizer_path("byte_bpe_50k.json"), "ranks": tokenizer_path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@query()
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), **packing_options())


@query(r"""
WITH r AS (SELECT page_id, concat('WARC/1.0', crlf, 'WARC-Type: resource', crlf, 'WARC-Record-ID: <urn:page:', page_id, '>', crlf,
                  'WARC-Date: 1970-01-01T00:00:00Z', crlf, 'WARC-Target-URI: ', coalesce(url, ''), crlf, 'Content-Type: text/html', crlf,
                  'Content-Length: ', strlen(coalesce(html, '')), crlf, crlf, coalesce(html, ''), crlf, crlf) AS record
           FROM pages, (SELECT chr(13) || chr(10) AS crlf))
SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256, page_id % 97 <> 13 AS intact FROM r
""")
def op6_warc_audit(spark, sf_dir):
    """The pages against a replica in which one record in 97 has another first character."""
    held = warc.records(table(spark, sf_dir, "pages"))
    damaged = F.concat(F.lit("#"), F.expr("substr(record, 2)"))
    replica = held.withColumn("record", F.when(F.col("id") % 97 == 13, damaged).otherwise(F.col("record")))
    found = warc.audit(held, replica)
    return found.select(F.col("id").alias("page_id"), "length", F.col("hash").alias("sha256"), "intact")


@query()
def op7_quality_pu(spark, sf_dir):
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op8_suffix_trees(spark, sf_dir):
    found = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_text", F.sha2("kept_text", 256)).withColumnRenamed("kept_text", "kept_sha256")


@query(f"""
WITH l AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)),
u AS (SELECT x, length(x) AS n, min((doc_id, p)) AS f FROM l WHERE length(x) >= {lines.SHORTEST} GROUP BY x),
near AS (SELECT a.x AS a, b.x AS b, a.n AS n, b.n AS m, a.f AS fa, b.f AS fb FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + 1 AND a.x <> b.x
         WHERE levenshtein(a.x, b.x) <= 4),
linked AS (SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS x FROM near
           WHERE len(list_filter(range(0, n + 1), lambda i: substr(a, 1, i) = substr(b, 1, i)
                     AND substr(a, CAST(i AS INT) + CASE WHEN n = m THEN 2 ELSE 1 END) = substr(b, CAST(i AS INT) + 2))) > 0),
gone AS (SELECT doc_id, p FROM l JOIN u USING (x) WHERE (doc_id, p) <> f OR x IN (SELECT x FROM linked)),
per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS s FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(s, '') AS removed_lines
FROM documents LEFT JOIN per USING (doc_id)
""")
def op9_line_dedup(spark, sf_dir):
    return _listed_lines(lines.line_verdicts(table(spark, sf_dir, "documents")))


@query()
def op9_line_dedup_by_length(spark, sf_dir):
    """Edits up to a tenth of the line, and equal lines of any length but none."""
    return _listed_lines(lines.line_verdicts(table(spark, sf_dir, "documents"), share=lines.SHARE, floor=1))


def _listed_lines(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines")
    )


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op10_winnowing(spark, sf_dir):
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.withColumn("items", F.sha2(listed, 256)).withColumnRenamed("items", "items_sha256")


_SHARE_SQL = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
t AS (SELECT lang, source, row, term, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= {divergence.DOCUMENTS}),
langs AS (SELECT l.lang, coalesce(sum(k.n), 0) AS total, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE_SQL.format(n="coalesce(c.n, 0)", total="g.total")} AS p, {_SHARE_SQL.format(n="k.n", total="langs.total")} AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN langs ON langs.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f, 0) AS value
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s
         ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {divergence.TOP}
""")
def op11_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT row, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS h FROM (SELECT row, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
again AS (SELECT row, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
part AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run
         FROM (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM again)),
span AS (SELECT row, min(i) AS a, max(i) + 400 AS b FROM part GROUP BY row, run),
kept AS (SELECT row, sum(b - a) AS n, count(*) AS spans, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM span GROUP BY row)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE substr(x, 1, CAST(2 * froms[1] AS BIGINT)) || array_to_string(list_transform(range(1, spans + 1),
         lambda k: substr(x, CAST(2 * tos[k] + 1 AS BIGINT), CAST(2 * (coalesce(froms[k + 1], length(x) // 2) - tos[k]) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
""")
def op12_suffix_array(spark, sf_dir):
    found = suffixarray.without_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


@query()
def op13_alignment(spark, sf_dir):
    found = alignment.alignment_scores(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
