"""Scans of knowledge sources and tables."""
