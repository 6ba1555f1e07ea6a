"""One relational step each: DataFrames in, a DataFrame out, no actions."""
