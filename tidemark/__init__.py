"""tidemark: trend discovery and forecasting over document collections, on Spark DataFrames."""
