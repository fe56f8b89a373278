"""Gridded time-series engine on Spark."""
