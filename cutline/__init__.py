"""Vehicle rescue-card catalogue as Spark DataFrame operators and batch jobs."""
