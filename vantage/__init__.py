"""Analytics operators for PySpark: every operator takes DataFrames and returns a DataFrame."""
