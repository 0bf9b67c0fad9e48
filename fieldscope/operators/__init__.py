"""Relational operators over items, scores, works, runs and journals."""
