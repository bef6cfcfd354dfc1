"""Spark-native table and stream operators: every function takes DataFrames and returns a DataFrame."""
