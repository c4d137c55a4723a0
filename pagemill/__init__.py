"""Document-text, usage and corpus operators on Spark DataFrames."""
