"""Operators for preparing training text at scale.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.  Each
module holds one operator with a general interface; ``queries.py`` holds the
thin ``opN_<name>`` queries that apply them to the standard tables.
"""
