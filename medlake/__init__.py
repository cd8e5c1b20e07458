"""Clinical-text, embedding and evaluation analytics on Spark DataFrames."""
