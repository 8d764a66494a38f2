"""Text governance and log analytics on Spark DataFrames."""
