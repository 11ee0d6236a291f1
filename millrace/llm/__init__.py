"""Operators for training-data pipelines: extraction, filters, near and exact repeats, packing."""
