"""Club scoring analytics as Spark DataFrame jobs."""
