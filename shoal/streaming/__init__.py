"""Incremental ingest of workbooks arriving in a folder (Structured Streaming)."""
