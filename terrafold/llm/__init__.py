"""Operators that prepare training text: sharding, tokens, near copies, filters.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the thin queries.
"""
