"""Queries over the driver tables."""

MODULES = ("panels", "columns", "joining", "statistics", "evaluation", "jobs", "publication", "modelling")
