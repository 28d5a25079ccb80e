"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; it imports nothing from
the rest.  Every operator has a general interface in its own module and a thin
query in :mod:`gridwright.llm.queries`.
"""
