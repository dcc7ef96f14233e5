"""Corpus operators for training-data pipelines, one module an operator.

Nothing else in the library imports this subpackage. ``registry`` has its queries.
"""
