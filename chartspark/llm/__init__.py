"""Operators for large training-text pipelines.

Self-contained: nothing else in the library imports this subpackage.
"""
