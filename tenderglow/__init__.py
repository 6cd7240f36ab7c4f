"""Public-tender notice analytics as PySpark DataFrame jobs."""
