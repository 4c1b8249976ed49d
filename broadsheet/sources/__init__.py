"""Readers: files and tables to DataFrames in the engine's shape."""
