"""Operators of a training-data pipeline. Nothing else in tracklake imports this subpackage."""
