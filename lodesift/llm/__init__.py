"""Operators that prepare training data: grouping, sampling, matching, splitting, encoding and text quality."""
