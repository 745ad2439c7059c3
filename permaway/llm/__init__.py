"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``registry`` derives the digest queries from them.
"""
