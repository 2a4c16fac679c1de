"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
