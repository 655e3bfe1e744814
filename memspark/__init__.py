"""memspark: a Spark-first analytics engine for long-term memory, hybrid retrieval and graph recall."""
