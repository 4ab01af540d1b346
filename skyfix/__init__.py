"""Geo-localization analytics as Spark DataFrame jobs."""
