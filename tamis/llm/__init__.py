"""Operators for large training corpora: one module per operator.

``queries`` registers them; ``corpus_pipeline.py`` at the repository top chains
five of them.  Nothing outside this subpackage imports it.
"""
