"""A Spark engine for recommending and exploring large collections of documents with embeddings."""
