"""Document retrieval and text analytics on Spark DataFrames."""
