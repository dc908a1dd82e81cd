"""Evidex: evidence analytics on Spark DataFrames."""
