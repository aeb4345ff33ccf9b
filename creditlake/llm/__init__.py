"""Operators of a training-data pipeline: text extraction, filtering,
deduplication, mixing and tokenising of large document collections.

Every operator takes and returns DataFrames; ``queries.py`` holds the thin
registered queries.  Nothing else in the library imports this subpackage.
"""
