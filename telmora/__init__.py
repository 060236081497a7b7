"""Telemetry analytics on Spark: spans, logs and metric points as DataFrames in, DataFrames out."""
