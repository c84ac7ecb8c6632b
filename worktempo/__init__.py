"""Developer-activity analytics as Spark DataFrame functions."""
