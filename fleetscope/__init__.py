"""Spark-native telemetry analytics: rollups, intervals, baselines, detectors, incidents, attribution and scoring."""
