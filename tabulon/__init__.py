"""Labelled tables on Spark: ``import tabulon.api as tb``."""
