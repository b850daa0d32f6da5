"""Operators: candidate search, pair features, model, decisions and metrics."""
