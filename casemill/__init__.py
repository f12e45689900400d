"""A case-intelligence analytics engine on Spark DataFrames."""
