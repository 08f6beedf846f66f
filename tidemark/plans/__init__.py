"""Queries by name, and the SQL they are held against."""
