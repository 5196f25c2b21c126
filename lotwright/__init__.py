"""Procurement line-item analytics expressed as Spark DataFrame and SQL jobs."""
