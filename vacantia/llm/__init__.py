"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it; `corpus_pipeline.py` and the
queries in `vacantia.llm.queries` are its only users.
"""
