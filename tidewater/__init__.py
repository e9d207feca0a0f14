"""Tidewater: open table formats as Spark DataFrames."""

__version__ = "0.1.0"
