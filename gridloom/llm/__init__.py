"""Operators for large training corpora: dedup, extraction, scoring, mixing, packing and search.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
