"""A data-preparation engine on Spark DataFrames."""
