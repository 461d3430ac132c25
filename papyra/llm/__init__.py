"""Operators of a training-data pipeline: dedup, filters, mixing, tokens, search.

Nothing else in the package imports this subpackage.
"""
