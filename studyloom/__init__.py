"""studyloom: document retrieval, study analytics and corpus preparation as Spark DataFrame jobs."""
