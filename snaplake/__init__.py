"""Snaplake: versioned Parquet tables and corpus operators on Spark."""
