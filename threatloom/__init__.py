"""Threat-telemetry analytics expressed as PySpark DataFrame operations."""
