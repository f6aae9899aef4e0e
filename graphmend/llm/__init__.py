"""Training-data operators: dedup, tokenising, packing, extraction, scoring.

Nothing else in the library imports this subpackage.
"""
