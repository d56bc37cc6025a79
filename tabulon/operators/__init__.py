"""Relational operators behind the labelled tables: aggregates, joins, reshaping, set operations."""
