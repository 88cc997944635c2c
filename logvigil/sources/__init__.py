"""Readers, ingest gates, sinks and the store."""
