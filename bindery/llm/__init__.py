"""Operators of a training-data pipeline: search, dedup, tokens, quality, extraction, mixing.

Nothing outside this package imports it. ``bindery.llm.queries`` holds the registered queries.
"""
