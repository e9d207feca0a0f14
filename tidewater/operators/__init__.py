"""Relational operators over files and actions."""
