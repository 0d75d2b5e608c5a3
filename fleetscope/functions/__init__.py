"""Part of the telemetry library."""
