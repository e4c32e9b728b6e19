"""Operators of sourceloom."""
