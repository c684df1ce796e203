"""Crowd-telemetry analytics expressed as Spark DataFrame and Structured Streaming operators."""
