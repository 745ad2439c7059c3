"""Outputs: centerline tables, drawn lines and archives."""
