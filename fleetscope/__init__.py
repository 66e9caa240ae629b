"""Telemetry analytics over fleets of database diagnostic bundles, on Spark DataFrames."""
