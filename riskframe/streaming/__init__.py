"""Structured Streaming jobs (ST-*)."""
