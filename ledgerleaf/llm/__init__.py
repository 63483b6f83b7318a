"""Operators for large text corpora: quality, deduplication, mixing, search, encoding, sharding.

Nothing outside this folder imports it. ``queries.py`` registers one query for
each operator; ``corpus_pipeline.py`` at the top of the repository chains five.
"""
