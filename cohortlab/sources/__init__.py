"""Scans of landed files and tables, and sinks."""
