"""lattica: lazy, dimension-aware analytics over Spark DataFrames."""
