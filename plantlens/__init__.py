"""Telemetry anomaly and alerting operators as Spark DataFrame programs."""
