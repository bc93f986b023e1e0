"""Spark jobs that turn gridded weather and public registers into ranked places."""
