"""Columns, text cleaning and mention extraction."""
