"""Declarative table operators and analytic procedures on Spark DataFrames."""
