"""The operators applied to the benchmark tables, each with an SQL twin."""
