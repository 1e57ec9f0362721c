"""Structured Streaming jobs for live ingest, live charts and summaries."""
