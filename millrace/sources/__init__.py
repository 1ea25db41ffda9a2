"""Readers, writers and stand-in views over the test tables."""
