"""Map documents to geographic features on Spark."""
