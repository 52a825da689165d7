"""Cohort studies on clinical event tables, as Spark DataFrame jobs."""
