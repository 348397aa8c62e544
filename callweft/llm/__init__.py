"""Operators of a training-data pipeline: filters, scans, deduplication, extraction, packing.

Nothing else in the library imports this subpackage.
"""
