"""Spark-native corpus, tokenizer and curation analytics."""

__version__ = "0.1.0"
