"""Data-lineage analytics on Spark DataFrames."""
