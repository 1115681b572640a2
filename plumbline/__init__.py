"""Honest figures over large collections of messy tables, as Spark jobs."""

__version__ = "0.1.0"
