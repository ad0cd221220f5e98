"""Operators that prepare training data for language models.

Each module holds one operator; ``queries`` holds the thin queries over the
``documents`` table.  Nothing outside this package imports it.
"""
