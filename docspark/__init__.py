"""docspark: Spark-first jobs for translating and preparing document corpora."""
