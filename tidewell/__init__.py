"""tidewell: a PySpark-native feed-ingestion and endpoint-analytics engine."""

__version__ = "0.1.0"
