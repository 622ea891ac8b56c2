"""Sensor-signal analytics on Spark: framing, features, vector search, graph scoring, adaptation and alerting."""
