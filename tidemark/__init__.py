"""Document retrieval, retrieval evaluation and chat analytics as Spark jobs."""
