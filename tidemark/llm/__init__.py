"""Operators that prepare text and vectors for language models.

Nothing outside this package imports it.
"""
