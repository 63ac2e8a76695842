"""Whole analyses and the queries over the driver's tables."""
