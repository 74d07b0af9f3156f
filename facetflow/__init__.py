"""Triangle-mesh analytics and constructive solid geometry on Spark DataFrames."""
