"""Job-posting ingestion, versioning, scoring and reporting as Spark DataFrame operators."""
