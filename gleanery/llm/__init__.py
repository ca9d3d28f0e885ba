"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; its queries are in
``queries`` and the staged corpus pipeline in ``corpus_pipeline`` at the top.
"""
