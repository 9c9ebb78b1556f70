"""Operators of a training-data pipeline over documents, pages and conversations.

Each module holds one operator with its own interface; ``queries`` binds them to the given
tables.  Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""

from __future__ import annotations
