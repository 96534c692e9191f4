"""Document-image and text analytics on Spark DataFrames."""
