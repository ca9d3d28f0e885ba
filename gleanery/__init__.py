"""Content curation as Spark DataFrame operators.

Captured feeds and pages become clean, deduplicated, scored, grouped items,
versioned enrichments, notes and a small explainable reading queue.
"""
