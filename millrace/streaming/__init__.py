"""Structured Streaming forms of the monitoring operators."""
