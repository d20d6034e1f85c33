"""Operators for building training corpora: deduplication, filtering, mixing, packing, search.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and their SQL.
"""
