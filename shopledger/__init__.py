"""Retail analytics as PySpark DataFrame jobs."""
