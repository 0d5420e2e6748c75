"""Analytics over software documentation, discussions and code models, on Spark DataFrames."""
