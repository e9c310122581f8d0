"""priorweave: find earlier items that match a new one, on Spark DataFrames, and measure how well that works."""
