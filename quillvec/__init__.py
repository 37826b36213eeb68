"""A PySpark engine for text embedding and vector retrieval."""
