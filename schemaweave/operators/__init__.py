"""Operators: DataFrame in, DataFrame out, every row keyed by script_id."""
