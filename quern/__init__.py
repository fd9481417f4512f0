"""Quern: keyed, loosely structured records on Spark DataFrames."""
