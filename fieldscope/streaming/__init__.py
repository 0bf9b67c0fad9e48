"""Structured Streaming forms of the sweep and its health checks."""
