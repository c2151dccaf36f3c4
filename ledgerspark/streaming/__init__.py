"""Structured Streaming ingestion of landed messages."""
