"""Operators of a training-data pipeline: search, language, scoring, tokens, duplicates."""
