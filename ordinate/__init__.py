"""ordinate: rank-addressed queries over Spark DataFrames."""
