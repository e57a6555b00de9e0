"""Dependency analysis of SQL schema scripts as Spark DataFrames."""
