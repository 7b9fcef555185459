"""Relational and model operators over interaction logs."""
