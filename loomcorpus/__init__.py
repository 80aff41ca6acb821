"""A Spark engine for building, indexing and searching web corpora."""
