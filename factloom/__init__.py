"""factloom: code-fact analytics and data processing on Spark DataFrames."""
