"""Operators for training data: percentiles, similar vectors, markup, tokens, packing, look-alike text.

Nothing outside this package imports it.
"""
