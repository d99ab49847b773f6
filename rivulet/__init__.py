"""Event-pipeline analytics on Spark DataFrames."""
