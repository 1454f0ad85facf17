"""Streams of scan events and file changes."""
