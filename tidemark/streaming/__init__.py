"""Incremental ingestion and live signals as Structured Streaming."""
