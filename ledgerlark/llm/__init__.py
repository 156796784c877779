"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` holds the thin registered queries.
"""
