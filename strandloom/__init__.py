"""Strandloom: sequence-assembly analytics and data preparation on Spark DataFrames."""
