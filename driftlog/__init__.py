"""Filesystem-recording analytics as PySpark DataFrame operators."""
