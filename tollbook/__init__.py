"""Telecom call-detail and prepaid-balance analytics as Spark DataFrame jobs."""
