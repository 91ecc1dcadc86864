"""A Spark engine for knowledge-graph question answering over document collections."""
