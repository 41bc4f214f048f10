"""Plumbline: exact code-index analytics as Spark DataFrame plans."""
