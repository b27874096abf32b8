"""Selection of functions from whole-program call graphs, on Spark DataFrames."""
