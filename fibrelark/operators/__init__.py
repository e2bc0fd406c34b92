"""Operators on telemetry tables."""
