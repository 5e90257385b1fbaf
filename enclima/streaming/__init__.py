"""Incremental landing of new files with Structured Streaming."""
