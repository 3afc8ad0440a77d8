"""Receivables decision analytics as PySpark DataFrame jobs."""
