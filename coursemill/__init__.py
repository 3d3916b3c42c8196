"""Spark jobs for time-aligned course material."""
