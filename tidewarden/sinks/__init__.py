"""Sinks: JSON lines, CSV, Turtle, N-Triples, state, reports."""
