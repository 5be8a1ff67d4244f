"""Vector retrieval and filtering on Spark DataFrames."""
