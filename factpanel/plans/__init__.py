"""Pipelines and the driver queries."""
