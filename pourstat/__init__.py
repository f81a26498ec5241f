"""Batch analytics for concrete test quality, written as Spark DataFrame jobs."""
