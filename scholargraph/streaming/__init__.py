"""Incremental ingest of new dump files with Structured Streaming."""
