"""Structured Streaming jobs: live segment ingestion and streaming monitoring."""
