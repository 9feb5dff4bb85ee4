"""Operators for training-data pipelines: cleaning, scanning, matching, packing of text tables."""
