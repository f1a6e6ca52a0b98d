"""Temporal analytics on change-log tables, written as Spark DataFrame plans."""

__version__ = "0.1.0"
