"""Scalar functions: alphabet, rule language and their SQL registration."""
