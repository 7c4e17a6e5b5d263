"""Continuous curation with Structured Streaming."""
