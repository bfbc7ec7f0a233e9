"""Image and rate-distortion analytics on Spark DataFrames."""
