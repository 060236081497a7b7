"""Structured Streaming variants of the ingest, roll-up, volume and alert jobs."""
