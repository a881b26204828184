"""Time-record analytics for many users on Spark DataFrames."""
