"""Operators for training-data pipelines: source files, near-duplicates, spans, encodings, leaks, mixes, quality."""
