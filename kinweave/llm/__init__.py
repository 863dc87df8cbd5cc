"""Operators for preparing training text at scale.

Each module holds one operator with a general DataFrame interface; ``queries`` derives the digest columns of the
registered queries from them.  Nothing else in the library imports this subpackage.
"""
