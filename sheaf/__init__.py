"""Sheaf: a PySpark engine that turns piles of documents into typed tables."""
