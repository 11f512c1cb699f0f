"""tessera: document retrieval, evaluation and corpus preparation on Apache Spark."""
