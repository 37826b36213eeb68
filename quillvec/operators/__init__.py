"""Operators on DataFrames of texts, tokens and vectors."""
