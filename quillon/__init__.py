"""Discrete structure learning, text classification and corpus operators on Spark DataFrames."""
