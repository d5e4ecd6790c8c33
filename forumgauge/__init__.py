"""Toxicity measurement for comment corpora, built on Spark DataFrames."""
