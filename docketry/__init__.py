"""Document-data analytics as Spark jobs."""
