"""Visual similarity and vector retrieval over Spark DataFrames."""
