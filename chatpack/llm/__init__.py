"""Operators of a training-data pipeline: tokens, mixing, scans, filters and near-duplicates."""
