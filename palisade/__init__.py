"""Security-telemetry analytics on Spark."""
