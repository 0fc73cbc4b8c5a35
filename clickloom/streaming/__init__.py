"""Streaming forms of the log's queries."""
