"""Spark-first analytics for urban tree inventories and record pipelines."""

__version__ = "0.1.0"
