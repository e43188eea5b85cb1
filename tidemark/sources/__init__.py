"""Panels from tables, and tables from panels."""
