"""Readers of exports and artifacts, and sinks."""
