"""Operators for large text corpora that are prepared for training."""
