"""Event-graph analytics on Spark DataFrames."""
