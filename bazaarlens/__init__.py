"""Listing valuation and corpus preparation as PySpark jobs."""
