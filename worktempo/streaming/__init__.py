"""Structured Streaming forms of the live figures."""
