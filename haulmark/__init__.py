"""haulmark: fleet-safety analytics and corpus preparation as plain PySpark DataFrame jobs."""
