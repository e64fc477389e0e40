"""Spark-native engine for hierarchical text corpora: parse, clean, chunk, embed, retrieve, evaluate."""
