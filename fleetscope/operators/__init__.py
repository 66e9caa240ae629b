"""Report operators. Each takes DataFrames plus column names and returns a lazy DataFrame."""
