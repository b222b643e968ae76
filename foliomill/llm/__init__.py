"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage (and ``corpus_pipeline``) imports it, so it can be left out.
"""
