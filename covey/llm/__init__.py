"""Operators for preparing training text at scale.

Each module holds one operator and its thin ``opN_<name>`` query.  Nothing
outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
