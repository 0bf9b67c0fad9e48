"""Readers of landed files, and the tables the radar appends to."""
