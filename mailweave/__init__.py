"""Correspondence analytics on Spark: message archives as DataFrames."""
