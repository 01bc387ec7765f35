"""Operators for building training data: deduplication, scans, language
identification, chat formatting, decontamination, packing and archive audit.

Nothing else in the library imports this package.
"""
