"""siltwork: hybrid document search and corpus analytics, declared as Spark plans."""
