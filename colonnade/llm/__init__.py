"""Operators of a training-data pipeline over documents, embeddings and pages.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`colonnade.llm.queries` holds the thin registered
queries that derive digest columns from the operators' outputs.
"""
