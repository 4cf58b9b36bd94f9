"""bourseflow: security-market analytics written as Spark DataFrame jobs."""
