"""Scans, canonical tables and sinks."""
