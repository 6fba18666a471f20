"""tacet: a Spark-native engine for ranking entities by how unusually silent they are."""

__version__ = "0.1.0"
