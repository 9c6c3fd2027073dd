"""Structured Streaming ingest: exactly-once commits of both table shapes, metrics, supervision, compaction."""
