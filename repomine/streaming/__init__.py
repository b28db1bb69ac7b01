"""Refreshes as Structured Streaming jobs."""
