"""Registered queries, each with SQL of the same result, and the Python API."""
