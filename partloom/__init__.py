"""Set-based product-structure analytics on Spark DataFrames."""
