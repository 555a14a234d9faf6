"""Spark-native operational analytics: logs, facts, rollups, settlements, lookups, forecasts, documents."""
