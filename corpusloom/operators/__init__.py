"""Operators on DataFrames: lines, chunks, enrichment, retrieval, evaluation, chat."""
