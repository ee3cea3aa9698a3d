"""tidelog: a versioned key-value table engine on Spark DataFrames."""
