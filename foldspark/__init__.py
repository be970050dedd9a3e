"""Tabular model evaluation as Spark plans."""
