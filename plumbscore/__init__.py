"""Train, evaluate and monitor models on tables and streams with Spark DataFrames."""
