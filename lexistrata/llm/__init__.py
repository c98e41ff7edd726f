"""Operators for training data: terms, names, value mapping, set joins, tokens, leakage and cut texts."""
