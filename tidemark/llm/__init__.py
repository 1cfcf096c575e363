"""Operators of a training-data pipeline: tokenising, deduplication, search, classifiers, packing and archives."""
