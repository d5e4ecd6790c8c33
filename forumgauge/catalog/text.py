"""Queries for corpus preparation."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import GERMAN_STOPWORDS, SUBTITLE_FILLERS
from ..operators import text as op
from ..operators.aggregates import count_by
from . import query
from .tables import WORD_SQL

STOP_SQL = ", ".join(f"'{w}'" for w in (*GERMAN_STOPWORDS, *SUBTITLE_FILLERS))
# A lemma dictionary over frequent words of the corpus.
LEMMAS = {"les": "le", "la": "le", "das": "der", "die": "der", "los": "el", "is": "be", "was": "be", "are": "be"}
LEMMA_SQL = "(VALUES " + ", ".join(f"('{w}', '{v}')" for w, v in LEMMAS.items()) + ") AS lemmas(word, lemma)"
# Unanchored patterns, as a list for dropping terms.
DROP_PATTERNS = ("^th", "tion", "schaft*", r"u\.a\.", "[Ee]in")


STEPS = [
    ("handles", tx.HANDLE, ""), ("urls", tx.URL, ""), ("html", tx.TAG, " "), ("emails", tx.EMAIL, ""),
    ("whitespace", r"\s+", " "), ("quadruple_quotes", '""""', ""), ("dots", tx.DOTS, ""), ("quotes", '"', ""),
    ("emoticons", tx.EMOTICON, ""), ("emoji", tx.EMOJI, tx.NO_BREAK_SPACE),
]
# A run of single capitals between blanks, and the run without its inner blanks.
SPACED = r"(?:^|\s)[A-Z](?:\s[A-Z]){2,}(?:\s|$)"


def _joined_sql(column: str) -> str:
    join = r"regexp_extract(m, '^\s?') || regexp_replace(m, '\s', '', 'g') || regexp_extract(m, '\s?$')"
    marked = f"string_split(regexp_replace({column}, '({SPACED})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"  # every second part is a run
    return f"array_to_string(list_transform({marked}, lambda m, i: CASE WHEN i % 2 = 0 THEN {join} ELSE m END), '')"


TWEET_STEPS = [*STEPS[:4], ("hashes", "#", ""), *STEPS[4:], ("handle_tails", r"@\S+", "")]


def _step_sql(column: str, pattern: str, by: str) -> str:
    return "regexp_replace({}, '{}', '{}', 'g')".format(column, pattern.replace("'", "''"), by)


def _clean_sql(column: str, steps: list[tuple[str, str, str]]) -> str:
    column = _joined_sql(column)
    for _, pattern, by in steps:
        column = _step_sql(column, pattern, by)
    return column


# Every text also spells its first letters, so that there are runs to join.
def _spelled_sql(column: str) -> str:
    return f"{column} || ' ' || regexp_replace(translate(substr({column}, 1, 12), '{ascii_lowercase}', '{ascii_uppercase}'), '([A-Z])', '\\1 ', 'g')"


def spelled(column: str):
    first = F.regexp_replace(F.translate(F.substring(column, 1, 12), ascii_lowercase, ascii_uppercase), "([A-Z])", "$1 ")
    return F.concat(F.col(column), F.lit(" "), first)


def _removal_sql() -> str:
    staged = f"SELECT {_spelled_sql('html')} AS t0 FROM pages"
    staged = f"SELECT *, {_joined_sql('t0')} AS t1 FROM ({staged})"
    for i, (_, pattern, by) in enumerate(STEPS, start=2):
        staged = f"SELECT *, {_step_sql(f't{i - 1}', pattern, by)} AS t{i} FROM ({staged})"
    rows = " UNION ALL ".join(
        f"SELECT {i} AS step_no, '{name}' AS step, count(*) FILTER (t{i} <> t{i - 1}) AS n FROM staged"
        for i, (name, _, _) in enumerate([("spaced_capitals", "", ""), *STEPS], start=1)
    )
    return f"WITH staged AS ({staged}) {rows}"


@query("clean_text", f"""
SELECT page_id, {_clean_sql("text", STEPS)} AS text_display FROM (
  SELECT page_id, {_spelled_sql("html")} AS text FROM pages UNION ALL SELECT doc_id, {_spelled_sql("text")} FROM documents)""")
def _(t):
    pages = t.texts("pages").select("page_id", F.col("html").alias("text"))
    texts = pages.unionByName(t.texts("documents").select(F.col("doc_id").alias("page_id"), "text"))
    return op.clean_text(texts.withColumn("text", spelled("text"))).select("page_id", "text_display")


@query("clean_text_tweets", f"""
SELECT doc_id, {_clean_sql('text', TWEET_STEPS)} AS text_display FROM (SELECT doc_id, {_spelled_sql('text')} AS text FROM documents)""")
def _(t):
    texts = t.texts("documents").withColumn("text", spelled("text"))
    return op.clean_text(texts, profile="tweet").select("doc_id", "text_display")


@query("clean_text_emails_first", f"""
SELECT doc_id, {_clean_sql('text', [STEPS[3], *STEPS[:3], *STEPS[4:]])} AS text_display
FROM (SELECT doc_id, text || ' Write to some.body@example.org or @somebody' AS text FROM documents)""")
def _(t):
    texts = t.texts("documents").withColumn("text", F.concat("text", F.lit(" Write to some.body@example.org or @somebody")))
    return op.clean_text(texts, emails_first=True).select("doc_id", "text_display")


@query("removal_counts", _removal_sql())
def _(t):
    return op.removal_counts(t.texts("pages").withColumn("html", spelled("html")), "html")


@query("portion_text", "SELECT id, group_no, md5(comments_reportion) AS portion_md5, length(comments_reportion) AS n_chars FROM portions", "portions")
def _(t):
    return t.portions.select(
        "id", "group_no", F.md5(F.col("comments_reportion").cast("binary")).alias("portion_md5"),
        F.length("comments_reportion").cast("bigint").alias("n_chars"),
    )


@query("tokenize_words", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM documents) GROUP BY word""")
def _(t):
    return count_by(op.tokenize_words(t.texts("documents"), keep=[]), "word")


NGRAMS_SQL = f"""
grams AS (
  SELECT vid, CASE WHEN len(tk) < 2 THEN NULL ELSE unnest(CASE WHEN len(tk) < 2 THEN [NULL] ELSE list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) END) END AS bigram
  FROM (SELECT conv_id AS vid, regexp_extract_all(lower(text), '{WORD_SQL}') AS tk FROM conversations))"""


@query("tokenize_ngrams", f"WITH {NGRAMS_SQL} SELECT vid, bigram, count(*) AS n FROM grams GROUP BY vid, bigram")
def _(t):
    return count_by(op.tokenize_ngrams(t.subtitles, keep=["vid"]), "vid", "bigram")


@query("split_ngrams", f"""WITH {NGRAMS_SQL}
SELECT split_part(bigram, ' ', 1) AS word1, split_part(bigram, ' ', 2) AS word2, bigram AS again, count(*) AS n FROM grams WHERE bigram IS NOT NULL GROUP BY bigram""")
def _(t):
    counts = count_by(op.tokenize_ngrams(t.subtitles, keep=[]), "bigram").where(F.col("bigram").isNotNull())
    split = op.split_ngrams(counts)
    united = op.unite_ngrams(split.withColumns({"w1": F.col("word1"), "w2": F.col("word2")}), "again")
    return united.select(F.col("w1").alias("word1"), F.col("w2").alias("word2"), "again", "n")


@query("remove_stopwords", f"SELECT vid, word, count(*) AS n FROM subtitle_words WHERE word NOT IN ({STOP_SQL}) GROUP BY vid, word", "subtitle_words")
def _(t):
    return count_by(op.remove_stopwords(t.subtitle_words, (*GERMAN_STOPWORDS, *SUBTITLE_FILLERS)), "vid", "word")


@query("remove_stopwords_table", f"""
WITH stop AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS w FROM benchmark)
SELECT vid, word, count(*) AS n FROM subtitle_words WHERE word NOT IN (SELECT w FROM stop) GROUP BY vid, word""", "subtitle_words")
def _(t):
    stop = op.tokenize_words(t.raw("benchmark"), keep=[])
    return op.remove_stopwords(count_by(t.subtitle_words, "vid", "word"), stop)


@query("remove_numbers", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM documents)
WHERE NOT regexp_matches(word, '^[\\d.,]+$') AND word <> '' GROUP BY word""")
def _(t):
    return op.remove_numbers(count_by(op.tokenize_words(t.texts("documents"), keep=[]), "word"))


@query("lemmatize", f"""
SELECT vid, coalesce(lemma, w.word) AS word, count(*) AS n FROM subtitle_words w LEFT JOIN {LEMMA_SQL} ON w.word = lemmas.word GROUP BY 1, 2""", "subtitle_words")
def _(t):
    dictionary = t.spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    return op.lemmatize(count_by(t.subtitle_words, "vid", "word"), dictionary, count="n")


@query("lemmatize_tokens", f"""
SELECT vid, segment_id, coalesce(lemma, w.word) AS word, count(*) AS n FROM subtitle_words w LEFT JOIN {LEMMA_SQL} ON w.word = lemmas.word GROUP BY 1, 2, 3""", "subtitle_words")
def _(t):
    dictionary = t.spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    return count_by(op.lemmatize(t.subtitle_words, dictionary), "vid", "segment_id", "word")


@query("remove_terms_regex", f"""
SELECT term, sum(n)::BIGINT AS n FROM source_terms
WHERE NOT regexp_matches(term, '{"|".join(DROP_PATTERNS)}') GROUP BY term""", "source_terms")
def _(t):
    totals = t.source_terms.groupBy("term").agg(F.sum("n").alias("n"))
    return op.remove_terms_regex(totals, DROP_PATTERNS)


@query("explode_term_list", r"""
SELECT doc_id, trim(regexp_replace(part, '\s+', ' ', 'g')) AS term FROM (
  SELECT doc_id, unnest(string_split(text, ',')) AS part FROM documents)""")
def _(t):
    return op.explode_term_list(t.texts("documents").select("doc_id", "text"), "text")
