"""Telemetry and fault-log risk analytics as Spark DataFrame operators."""
