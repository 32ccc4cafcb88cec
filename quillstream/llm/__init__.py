"""Training-data operators: deduplication, quality, scoring, decontamination and mixing.

Self-contained: nothing outside this package imports it.
"""
