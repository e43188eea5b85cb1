"""After-the-fact evaluation of investment strategies over Spark DataFrames."""
