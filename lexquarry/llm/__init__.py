"""Operators of a training-data pipeline: filters, near-duplicates, tokens, packing, scoring.

Nothing else in the library imports this subpackage.
"""
