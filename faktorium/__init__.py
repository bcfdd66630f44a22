"""Structured e-invoice processing and analysis as Spark DataFrame jobs."""

__version__ = "0.1.0"
