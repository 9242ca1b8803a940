"""Operators for training data: record matching, packing, leakage and truncation. Nothing outside imports this package."""
