"""Analytics over sparse feature-by-observation counts, as Spark DataFrames."""
