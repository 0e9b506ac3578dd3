"""unitloom: corpus-unit analytics expressed as Spark DataFrame jobs."""
