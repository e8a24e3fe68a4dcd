"""Table operators: DataFrames in, DataFrame out, column names as parameters."""
