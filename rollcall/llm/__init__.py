"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``rollcall.llm.queries`` registers
one query per operator and ``corpus_pipeline.py`` chains five of them.
"""
