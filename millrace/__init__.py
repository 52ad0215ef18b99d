"""A contract-driven analytics engine on PySpark DataFrames."""
