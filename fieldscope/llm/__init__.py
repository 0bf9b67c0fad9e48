"""Operators for preparing training data, each also registered as a query."""
