"""Triples: a set of (s, p, o) rows, how they are made, matched, checked and written."""
