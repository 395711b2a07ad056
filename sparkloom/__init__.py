"""A knowledge and retrieval engine on PySpark."""
