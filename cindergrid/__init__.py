"""Gridded risk and spread analytics as Spark jobs."""
