"""Road-safety scoring and risk-aware walking routes on Spark DataFrames."""
