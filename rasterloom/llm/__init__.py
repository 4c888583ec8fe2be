"""Operators for training-data pipelines (deduplication, extraction, scoring, packing).

Nothing outside this package imports it; ``queries`` lists what the driver runs.
"""
