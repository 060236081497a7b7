"""Reading, ingesting and writing telemetry tables."""
