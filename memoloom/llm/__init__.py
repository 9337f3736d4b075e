"""Operators of a training-data pipeline: one module per operator, the registered queries in ``queries``.

Nothing else in the library imports this subpackage; it may be removed without touching the rest.
"""
