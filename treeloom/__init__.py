"""Set-wise analytics over fleets of versioned folders, and batch operators for training data, on Spark DataFrames."""
