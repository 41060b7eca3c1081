"""Full-text search, ranked retrieval and text analytics as Spark DataFrames."""
