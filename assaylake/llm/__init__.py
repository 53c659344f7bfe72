"""Operators for training data: deduplication, tokenization, packing, quality, search, chat.

Nothing else in the library imports this package.
"""
