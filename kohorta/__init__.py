"""kohorta: labelled-cohort analytics as Spark jobs."""
