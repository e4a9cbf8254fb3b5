"""Training-data operators on whole corpora: scoring, deduplication, filtering and encoding.

Nothing outside this subpackage imports it, so it can be removed as a unit.
"""
