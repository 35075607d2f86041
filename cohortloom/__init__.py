"""Observational-study engine on Spark DataFrames."""
