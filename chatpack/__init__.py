"""chatpack: conversational training data with Spark DataFrames."""
