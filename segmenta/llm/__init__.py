"""Operators of a training-data pipeline: deduplication, tokenising, packing, quality
scoring, personal data and secret scans, sharding and fingerprints.

Nothing else in the library imports this subpackage.  Each operator module documents its
method, its general interface and its results for nulls, empty texts, ties and repeated
rows; ``queries`` holds the registered queries.
"""
