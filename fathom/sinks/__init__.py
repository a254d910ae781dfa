"""Exports, reports and tables."""
