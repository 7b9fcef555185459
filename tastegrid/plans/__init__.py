"""Whole jobs: fixture logs, split preparation, benchmark and retrieval."""
