"""Readers and writers: delivery files, Parquet tables, small report sinks."""
