"""Schemas, readers, sinks and batch ingest."""
