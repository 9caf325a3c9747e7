"""Operators that prepare training data. Nothing outside this subpackage imports it."""
