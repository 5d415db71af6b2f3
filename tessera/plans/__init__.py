"""Pipelines composed of the operators."""
