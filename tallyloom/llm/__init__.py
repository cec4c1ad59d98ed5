"""Operators for large training-data corpora: deduplication, filters, privacy, tokens.

One module per operator; ``queries`` registers them. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
