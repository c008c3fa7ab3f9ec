"""Operators on DataFrames: normalization, blocking, pair features, context, decoding, metrics, models."""
