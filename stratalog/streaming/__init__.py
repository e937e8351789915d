"""Incremental ingestion of runs with Structured Streaming (an extension)."""
