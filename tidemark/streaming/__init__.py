"""Structured Streaming pipelines over file sources."""
