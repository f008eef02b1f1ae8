"""Structured Streaming jobs for the work queue and ingest."""
