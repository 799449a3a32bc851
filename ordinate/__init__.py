"""Order-aware sequence queries on PySpark DataFrames."""
