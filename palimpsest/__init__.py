"""Palimpsest: versioned array and table data on Spark."""

__version__ = "0.1.0"
