"""Structured Streaming views of the log."""
