"""planloom: prepare, replay and score planning data with Spark DataFrames."""
