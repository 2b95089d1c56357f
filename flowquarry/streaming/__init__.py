"""Structured Streaming forms of the operators; event time is the time in the data."""
