"""helixframe: sequence alignment and similarity search on Spark DataFrames."""
