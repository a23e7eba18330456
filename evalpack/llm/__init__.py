"""Training-data operators: filters, dedup, scans, extraction and packing.

Nothing else in the package imports this subpackage.
"""
