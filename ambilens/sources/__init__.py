"""Readers: corpus CSV, raw archives, Parquet tables."""
