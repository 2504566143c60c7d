"""Road-network planning and training-data preparation as PySpark jobs."""
