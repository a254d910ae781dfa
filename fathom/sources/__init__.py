"""Readers, dimensions, the table store and filing payloads."""
