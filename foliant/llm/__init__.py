"""Operators that prepare training data from study texts."""
