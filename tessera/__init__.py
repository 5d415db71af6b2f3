"""Spatial array and point analytics on Spark."""
