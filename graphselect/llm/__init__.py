"""Training-data operators: tokenisation, packing, quality, extraction, deduplication, scoring.

Nothing outside this subpackage imports it.
"""
