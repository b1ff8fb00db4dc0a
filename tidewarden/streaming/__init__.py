"""Incremental runs as streams, and extensions on event streams."""
