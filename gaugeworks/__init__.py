"""Machine-telemetry analytics on Spark: ingest of JSON snapshots, wide and narrow tables, and the queries on them."""
