"""provenir: evidence analytics on Spark DataFrames."""
