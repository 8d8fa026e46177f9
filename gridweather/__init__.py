"""Gridded weather analytics written as Spark DataFrame, ML and Structured Streaming jobs."""
