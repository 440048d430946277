"""Price models on Spark ML."""
