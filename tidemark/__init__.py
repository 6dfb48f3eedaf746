"""Tidemark: point-in-time, cross-sectional analytics as Spark plans."""
