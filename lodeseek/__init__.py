"""lodeseek: a Spark-native engine for indexing, searching and curating code and documents."""

__version__ = "0.1.0"
