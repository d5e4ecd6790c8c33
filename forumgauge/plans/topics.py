"""What episodes are about, and which topics go with toxic comments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relate
from ..operators.terms import frequent_counts, term_vectors, vocabulary
from ..operators.text import remove_numbers, remove_stopwords
from ..operators.topics import (
    TOPIC_NUMBERS, TopicModel, fit_topics, heldout_split, k_diagnostics, top_terms, topic_docs, topic_terms,
)
from ..session import written


@dataclass
class Corpus:
    """A trimmed document-term table, split and encoded, all written once."""

    training: DataFrame
    heldout: DataFrame
    vocab: DataFrame
    vectors: DataFrame


def prepare(
    texts: DataFrame, stopwords: Sequence[str] | DataFrame, dictionary: DataFrame | None = None,
    sparsity: float = 0.94, document: str = "document", text: str = "text",
) -> Corpus:
    """Counts of words, without stop words and numbers, of lemmas, of frequent terms.

    Only counts of words that may pass are shuffled by document and written; what comes before is counted text by text.
    """
    chosen = lambda words: remove_numbers(remove_stopwords(words, stopwords, ["term"]), "term")
    source = texts.select(F.col(document).alias("document"), F.col(text).alias("text"))
    counts = frequent_counts(source, sparsity, chosen, dictionary)
    training, heldout = heldout_split(written(counts.select("document", "term", "n")))
    training, heldout = written(training), written(heldout)
    vocab = written(vocabulary(training))
    return Corpus(training, heldout, vocab, written(term_vectors(training, vocab)))


def compare_topic_numbers(
    corpus: Corpus, ks: Sequence[int] = TOPIC_NUMBERS, max_iter: int = 200, tolerance: float = 1e-5,
    covariates: DataFrame | None = None, key: str = "document",
):
    """The models and the table of diagnostics that helps to choose between them."""
    models = fit_topics(corpus.vectors, ks, max_iter, tolerance, covariates, key)
    return models, k_diagnostics(models, corpus.vocab, corpus.training, corpus.heldout)


def topics_and_toxicity(model: TopicModel, corpus: Corpus, episodes: DataFrame, shares: DataFrame, alpha: float = 0.001):
    """The regression of toxic share on topics, and the episodes of significant topics."""
    k, gamma = model.k, written(topic_docs(model))
    terms = top_terms(topic_terms(model, corpus.vocab), 8)
    table = written(relate.topic_regression(gamma, shares, k, terms))
    # at most one row per topic of the model
    chosen = [r["topic"] for r in relate.significant_topics(table, alpha, strict=True, positive=True).collect()]
    daily = relate.topics_over_time(gamma, shares, terms)
    return table, relate.topic_episodes(daily, episodes, shares, chosen)
