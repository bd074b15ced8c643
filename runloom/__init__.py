"""Workflow lineage, run logs, run matrices and configuration as Spark tables."""
