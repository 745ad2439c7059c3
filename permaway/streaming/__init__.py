"""Streaming wrappers around the batch transforms."""
