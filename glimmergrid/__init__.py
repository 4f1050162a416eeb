"""Image similarity search and data preparation as Spark jobs."""
