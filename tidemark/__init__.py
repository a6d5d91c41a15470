"""Cohort, text and risk analytics written as Spark DataFrame jobs."""
