"""Shelf-life and expiration-risk analytics as PySpark DataFrame jobs."""
