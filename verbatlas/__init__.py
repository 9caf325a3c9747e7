"""Hybrid search, document ETL and corpus preparation as Spark DataFrame jobs."""
