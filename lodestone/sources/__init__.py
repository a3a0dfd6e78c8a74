"""Readers of source trees, journals, call logs, CSV files and markdown tables."""
