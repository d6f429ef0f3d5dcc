"""Operators for preparing training corpora: deduplication, filtering, mixing, packing.

Nothing else in the library imports this subpackage.
"""
