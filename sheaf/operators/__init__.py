"""Operators over DataFrames: geometry, extraction, clustering, reconciliation, cells, rows, review."""
