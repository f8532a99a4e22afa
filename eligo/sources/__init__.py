"""Scans, parsers and the source dimension."""
