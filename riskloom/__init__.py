"""Set-based financial-risk analytics on PySpark: every capability is a function from DataFrames to DataFrames."""
