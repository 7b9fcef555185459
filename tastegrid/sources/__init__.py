"""Readers and writers for logs, features, splits and results."""
