"""bitloom: information-theoretic sequence analytics on PySpark.

Sequences are rows, code lengths are columns (in bits), and every operator is a
function from DataFrames to a DataFrame.
"""
