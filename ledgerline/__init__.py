"""Reconciliation of datasets and ETL of framed files, written as Spark jobs."""

__version__ = "0.1.0"
