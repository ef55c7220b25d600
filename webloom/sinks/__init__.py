"""Keyed writes, SQL statements, files and exports."""
