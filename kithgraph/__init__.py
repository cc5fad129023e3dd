"""Local-community analytics on Spark."""
