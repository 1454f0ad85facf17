"""Analytics over document collections and the knowledge graphs derived from them, on Spark DataFrames."""
