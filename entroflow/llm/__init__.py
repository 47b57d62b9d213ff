"""Operators for preparing training data: search, deduplication, scans, mixing and tokens.

Nothing else in the package imports this subpackage.
"""
