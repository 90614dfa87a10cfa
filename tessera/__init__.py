"""Entity-resolution and data-preparation operators on Spark DataFrames."""
