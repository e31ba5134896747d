"""Operators for building training corpora at scale.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries over the standard tables.
"""
