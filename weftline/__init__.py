"""weftline: evidence queries and batch analytics expressed on Spark DataFrames."""
