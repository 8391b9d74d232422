"""tidemark: time-series relational operators on Spark DataFrames."""
