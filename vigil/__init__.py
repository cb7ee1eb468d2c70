"""Telemetry risk analytics as Spark DataFrame operators."""
