"""Document and table analytics on Spark DataFrames."""
