"""Corpus operators for training-data preparation (optional subpackage)."""
