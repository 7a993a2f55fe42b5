"""Operators for training-data pipelines: mixing, fingerprints, search, scans, counts and models."""
