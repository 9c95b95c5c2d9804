"""Security-event analytics as plain PySpark jobs."""
