"""Operators for preparing language-model training data at scale.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
