"""Operators for large text corpora: deduplication, scoring, filtering, packing, archiving, extraction.

Nothing outside this subpackage imports it; ``queries`` lists what the driver runs.
"""
