"""Quantitative research on bar-level market data, expressed as Spark DataFrame jobs."""
