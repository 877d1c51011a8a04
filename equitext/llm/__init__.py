"""Operators of a training-data pipeline (dedup, filtering, extraction,
tokenisation) over the ``documents`` / ``pages`` tables.

Nothing else in the library imports this subpackage.
"""
