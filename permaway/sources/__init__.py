"""Scans of drawn paths and centerline tables, and their sinks."""
