"""Scalar functions as Column expressions, and their Python twins for page kernels."""
