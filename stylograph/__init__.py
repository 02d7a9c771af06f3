"""Stylometric authorship analytics and text-corpus processing on Spark DataFrames."""
