"""Operators for text corpora: personal data, overlap, duplicates, quality, mixing and token files.

Nothing else in the library imports this package.
"""
