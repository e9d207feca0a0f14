"""Registered queries over the table formats."""
