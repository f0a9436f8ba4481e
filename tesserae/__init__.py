"""Analytics operators for labelled text-and-graph datasets, written on Spark DataFrames."""
