"""Incremental runs of the stateless plans."""
