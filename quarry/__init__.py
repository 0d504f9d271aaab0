"""quarry: the reference's analyses as distributed Spark DataFrame jobs."""
