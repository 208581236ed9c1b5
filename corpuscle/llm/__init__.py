"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries are in
``corpuscle.llm.queries`` and are added by ``__spark_entry__.py`` when present.
"""
