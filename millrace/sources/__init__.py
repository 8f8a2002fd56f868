"""Scans, sinks and the metadata catalog."""
