"""Queries on telemetry, readings, request logs and ingest batches: pure functions of DataFrames."""
