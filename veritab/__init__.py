"""Tabular profiling, cleaning, scoring and modelling expressed as Spark jobs."""
