"""Coverage-evidence analytics as Spark jobs."""
