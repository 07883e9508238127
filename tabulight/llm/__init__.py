"""Operators for large text-training data: one module an operator, queries in ``queries.py``."""
