"""Schemas, table readers and writers, and test tables derived from the given Parquet files."""
